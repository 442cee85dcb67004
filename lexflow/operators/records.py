"""JSON records of the pipeline: recogniser output, session transcripts, usage windows and nested settings.

Texts are parsed once into variants on the JVM; shapes are told apart by the variant's own
schema, and nothing is collected per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import env_key
from ..runtime import cut_lineage

# The fields of a named credential, in the order in which they are looked for.
NAME_FIELDS = ("name", "key", "env", "env_var", "variable")
VALUE_FIELDS = ("value", "token", "secret", "credential", "url", "api_key")
TAIL = 131_072  # bytes at the end of a transcript that are read


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, BOOLEAN, ARRAY, OBJECT or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_number(value: Column) -> Column:
    return _kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def recognised_records(outputs: DataFrame, key: str, output: str, first: bool = False) -> DataFrame:
    """``key``, ``image``, ``ok``, ``markdown``, ``error``: one record per image of a recogniser's output.

    An output is a wrapper object with ``results``, an array, a single record, or such values
    line by line (where every line is a value of its own); what is no record with a text
    ``image`` is skipped. Of an image's records the last one counts, or the ``first`` one, as
    when records are taken while they arrive.
    """
    lines = F.transform(F.filter(F.split(output, "\n"), lambda x: F.trim(x) != ""), lambda x: F.try_parse_json(F.trim(x)))
    read = outputs.select(F.col(key).alias("key"), lines.alias("lines"), F.try_parse_json(F.col(output)).alias("whole"))
    by_line = F.forall("lines", lambda v: v.isNotNull()) | F.col("whole").isNull()
    payloads = read.select("key", F.posexplode(F.when(by_line, F.filter("lines", lambda v: v.isNotNull())).otherwise(F.array("whole"))).alias("line", "payload"))
    results = F.try_variant_get("payload", "$.results", "array<variant>")
    array = F.try_variant_get("payload", "$", "array<variant>")
    records = payloads.select("key", "line", F.posexplode(F.coalesce(results, array, F.array("payload"))).alias("nth", "record"))
    records = records.where(_kind(F.col("record")) == "OBJECT")
    image = F.try_variant_get("record", "$.image", "variant")
    named = records.where(_kind(image) == "STRING").select("key", "line", "nth", F.try_variant_get("record", "$.image", "string").alias("image"), F.try_variant_get("record", "$.ok", "boolean").alias("ok"), F.try_variant_get("record", "$.markdown", "string").alias("markdown"), F.try_variant_get("record", "$.error", "string").alias("error"))
    pick = F.min_by if first else F.max_by
    kept = named.groupBy("key", "image").agg(pick(F.struct("ok", "markdown", "error"), F.struct("line", "nth")).alias("r"))
    return kept.select(F.col("key").alias(key), "image", "r.*")


def transcript_entries(transcripts: DataFrame, key: str, content: str, tail: int = TAIL) -> DataFrame:
    """``key``, ``pos``, ``entry`` (variant): the objects in the last ``tail`` bytes of each transcript, line by line.

    A cut first line, blank lines, lines that are no JSON object, and entries of side chains
    are skipped. The limit is part of the result, not a shortcut.
    """
    raw = F.encode(F.col(content), "UTF-8")
    cut = F.octet_length(raw) > tail
    read = transcripts.select(F.col(key).alias("key"), cut.alias("cut"), F.decode(F.when(cut, F.substring(raw, -tail, tail)).otherwise(raw), "UTF-8").alias("text"))
    whole = F.when(~F.col("cut"), F.col("text")).when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise("")
    lines = read.select("key", F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
    entries = lines.select("key", "pos", F.try_parse_json(F.trim("line")).alias("entry")).where("entry is not null")
    entries = entries.where(_kind(F.col("entry")) == "OBJECT").where(~F.coalesce(F.try_variant_get("entry", "$.isSidechain", "boolean"), F.lit(False)))
    return entries.select(F.col("key").alias(key), "pos", "entry")


def token_totals(entries: DataFrame, key: str) -> DataFrame:
    """``key``, ``entries``, ``tokens``: input and output tokens over the assistant entries that are no error and tell their usage."""
    usage = F.try_variant_get("entry", "$.message.usage", "variant")
    counted = (F.try_variant_get("entry", "$.type", "string") == "assistant") & ~F.coalesce(F.try_variant_get("entry", "$.isApiErrorMessage", "boolean"), F.lit(False)) & (_kind(usage) == "OBJECT")
    used = lambda name: F.coalesce(F.try_variant_get("entry", f"$.message.usage.{name}", "bigint"), F.lit(0))
    return entries.groupBy(key).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.when(counted, used("input_tokens") + used("output_tokens"))), F.lit(0)).alias("tokens"))


def speed(tokens: Column, seconds: Column) -> Column:
    """Tokens in a second as text, from a thousand on in thousands; null where either is not above zero."""
    rate = tokens / seconds
    text = F.when(rate >= 1000, F.concat(F.format_string("%.1f", F.bround(rate / 1000, 1)), F.lit("k t/s"))).otherwise(F.concat(F.format_string("%.1f", F.bround(rate, 1)), F.lit(" t/s")))
    return F.when((tokens > 0) & (seconds > 0), text)


def live_windows(caches: DataFrame, key: str, payload: str, now_us: Column) -> DataFrame:
    """``key``, ``kind``, ``percent``, ``resets_us``: the usage windows of each cached payload that are still open at ``now_us``.

    A payload that is no object, or whose ``rate_limits`` are none, has no window. A window
    without a numeric percentage (a boolean is none) is skipped, one that has been reset is
    closed, and one whose reset time cannot be read stays.
    """
    limits = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.rate_limits", "map<string, variant>")
    windows = caches.select(F.col(key).alias("key"), now_us.alias("now"), F.explode(limits).alias("kind", "window")).where(_kind(F.col("window")) == "OBJECT")
    percent, reset = F.try_variant_get("window", "$.used_percentage", "variant"), F.try_variant_get("window", "$.resets_at", "variant")
    text = F.try_variant_get("window", "$.resets_at", "string")
    iso = F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z"))))
    seconds = F.when(is_number(reset) | (_kind(reset) == "STRING"), text.try_cast("double"))
    resets = F.coalesce(F.when(_kind(reset) == "STRING", F.unix_micros(iso)), F.when(F.abs(seconds) < 1e11, (seconds * 1_000_000).try_cast("bigint")))
    opened = windows.where(is_number(percent)).select("key", "kind", F.try_variant_get("window", "$.used_percentage", "double").alias("percent"), resets.alias("resets_us"), "now")
    return opened.where("resets_us is null or resets_us > now").select(F.col("key").alias(key), "kind", "percent", "resets_us")


def window_state(percent: Column, deny: float = 99.0, offer: float = 90.0) -> Column:
    """exhausted from ``deny`` percent on, offered above ``offer``, else open."""
    return F.when(percent >= deny, "exhausted").when(percent > offer, "offered").otherwise("open")


def is_stale(modified_us: Column, now_us: Column, seconds: int = 21_600) -> Column:
    """Whether a cache is older than ``seconds``; exactly so old is not."""
    return now_us - modified_us > seconds * 1_000_000


def flattened(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, ``name``, ``value``, ``state``: the scalars of nested JSON under names like environment keys.

    Names of levels are joined by underscores, list items count from 1, booleans are lower
    case. ``state`` is ``null`` for a null, ``conflict`` where one name has different values,
    else ``set``. Every turn opens one level of all rows; it ends with the deepest.
    """
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("name"), F.try_parse_json(F.col(payload)).alias("value")).where("value is not null")
    found = None
    while True:
        level = cut_lineage(level.select("key", "name", "value", _kind(F.col("value")).alias("kind")))
        flat = level.where("kind not in ('OBJECT', 'ARRAY') and name <> ''").select("key", "name", F.when(F.col("kind") != "VOID", F.col("value").cast("string")).alias("value"))
        found = flat if found is None else found.unionByName(flat)
        nested = level.where("kind in ('OBJECT', 'ARRAY')")
        if nested.isEmpty():
            break
        opened = rows.sparkSession.sql("SELECT n.key, n.name, x.pos, x.key AS child, x.value FROM {n} n, LATERAL variant_explode(n.value) x", n=nested)
        part = F.coalesce(env_key(F.col("child")), (F.col("pos") + 1).cast("string"))
        level = opened.select("key", F.concat_ws("_", F.nullif("name", F.lit("")), part).alias("name"), "value")
    values = found.groupBy("key", "name").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n"))
    state = F.when(F.col("n") == 0, "null").when(F.col("n") > 1, "conflict").otherwise("set")
    return values.select(F.col("key").alias(key), "name", "value", state.alias("state"))


def env_values(lines: DataFrame, line: str, position: str) -> DataFrame:
    """``name``, ``pos``, ``value``: the settings of an environment file, in file order; a name may come several times.

    Blank lines, comments and lines without a value are skipped; ``export`` before a name and
    quotes around a value are not part of them, and an escaped quote stands for a quote.
    """
    m = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([^\s#'\"][^#]*?)?)\s*(?:#.*)?$"
    part = lambda n: F.regexp_extract(line, m, n)
    quoted = F.regexp_replace(F.concat(part(2), part(3)), r"\\(['\"\\])", "$1")
    read = lines.where(F.col(line).rlike(m)).select(part(1).alias("name"), F.col(position).alias("pos"), F.when(quoted != "", quoted).otherwise(part(4)).alias("value"))
    return read.where("name <> ''")


def env_line(name: Column, value: Column) -> Column:
    """A setting as a line of an environment file; a value is quoted unless it has letters and digits only."""
    return F.concat(name, F.lit("="), F.when(value.rlike(r"^[\p{L}\p{N}]+$"), value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def named_credentials(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, ``name``, ``value``, ``state`` of each credential object: the first name field with text, and the first value field that is there.

    ``state`` is ``set``, ``null`` where that value is null, ``missing`` where there is no value
    field; objects without a name, and what is no object, have no row.
    """
    item = F.try_parse_json(F.col(payload))
    read = rows.select(F.col(key).alias("key"), item.alias("item")).where(_kind(F.col("item")) == "OBJECT")
    field = lambda name: F.try_variant_get("item", f"$.{name}", "variant")
    text = lambda name: F.when(_kind(field(name)) == "STRING", F.nullif(F.trim(F.try_variant_get("item", f"$.{name}", "string")), F.lit("")))
    value = F.coalesce(*(F.when(field(v).isNotNull(), F.struct(F.try_variant_get("item", f"$.{v}", "string").alias("value"), (_kind(field(v)) == "VOID").alias("none"))) for v in VALUE_FIELDS))
    found = read.select("key", env_key(F.coalesce(*map(text, NAME_FIELDS))).alias("name"), value.alias("v")).where("name is not null")
    state = F.when(F.col("v").isNull(), "missing").when(F.col("v.none"), "null").otherwise("set")
    return found.select(F.col("key").alias(key), "name", "v.value", state.alias("state"))
