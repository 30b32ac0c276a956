"""Content packs and recorded documents: readers, selection of sources, cache lookup, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders and file names that are not about a project, and extensions of texts.
SKIP_DIRS = ("node_modules", "venv", "env", "out", "dist", "build", "site-packages", "__pycache__", "target", "vendor", "coverage", "htmlcov")
SKIP_NAMES = r"(?i)^(license|licence|copying|notice|code_of_conduct|security|pull_request_template|requirements|constraints|packages\.txt|runtime\.txt|robots\.txt|cmakelists)"
TEXT_EXT = (".md", ".markdown", ".rst", ".txt", ".adoc")


def _files(spark: SparkSession, path: str, pattern: str, folder: str = "") -> DataFrame:
    """(name, raw) of the files right under ``path``, or in its ``folder``, each read whole.

    A folder of part files, as Spark writes one, has the folder's name: ``x.json/part-0`` is a file of x.json.
    """
    found = spark.read.text(f"{path}/{folder}" if folder else path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    at = F.col("_metadata.file_path")
    if folder:
        name = F.regexp_extract(at, rf"/{folder}/(?:[^/=]+=)?([^/]+)", 1)
    else:
        name = F.substring_index(at, f"/{path.rstrip('/').split('/')[-1]}/", -1)
        found = found.where(~name.contains("/"))
    return found.select(F.url_decode(name).alias("name"), F.col("value").alias("raw"))


def whole_json(raw: Column) -> Column:
    """A text that is one JSON value and nothing else as a VARIANT, else null: a value with something after it is none."""
    one = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    alone = F.try_variant_get(one, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(one, "$[0]", "variant"))


def _shape(v: Column) -> Column:
    """object, array or other, of a VARIANT."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("other")


def variant_kind(v: Column) -> Column:
    """K03 for a VARIANT: series, table, quote, metric or record, by the keys of an object."""
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    metric = has("value") | (has("before") & has("after"))
    return F.when(has("categories") & has("series"), "series").when(has("header") & has("rows"), "table").when(has("text") & has("author"), "quote").when(metric, "metric").otherwise("record")


def json_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments, warnings) of JSON files (name, raw), each read whole, so a pretty-printed one is one value.

    An object gives a fragment (frag_id, kind, title, text, data as VARIANT, source) for each key that does not begin with
    an underscore; a key with a colon is the id itself, else the file's stem goes before it. An array is one record. A file
    that is no JSON, or a single value, gives a warning and no failure.
    """
    f = files.withColumn("data", whole_json(F.col("raw"))).withColumns({"shape": _shape(F.col("data")), "stem": F.regexp_replace("name", r"\.[^.]*$", "")})
    empty = F.lit("")
    listed = f.where("shape = 'array'").select(F.concat(F.lit("json:"), "stem").alias("frag_id"), F.lit("record").alias("kind"), empty.alias("title"), empty.alias("text"), "data", F.col("name").alias("source"))
    keys = f.where("shape = 'object'").select("name", "stem", "data").lateralJoin(f.sparkSession.tvf.variant_explode(F.col("data").outer()))
    each = keys.where(~F.col("key").startswith("_")).withColumn("own", _shape(F.col("value")))
    said = lambda k: F.try_variant_get("value", f"$.{k}", "string")
    is_object = F.col("own") == "object"
    named = each.select(
        F.when(F.col("key").contains(":"), F.col("key")).otherwise(F.concat_ws(":", "stem", "key")).alias("frag_id"), F.when(is_object, variant_kind(F.col("value"))).when(F.col("own") == "array", "record").otherwise("text").alias("kind"),
        F.when(is_object, F.coalesce(F.nullif(said("title"), empty), said("label"), empty)).otherwise("").alias("title"),
        F.when(F.col("own") == "other", F.coalesce(F.try_variant_get("value", "$", "string"), empty)).when(is_object & (variant_kind(F.col("value")) == "quote"), said("text")).otherwise("").alias("text"),
        F.when(F.col("own") != "other", F.col("value")).alias("data"), F.col("name").alias("source"),
    )
    bad = f.where("shape is null or shape = 'other'").select(F.col("name").alias("source"), F.lit("unreadable").alias("warning"))
    return named.unionByName(listed), bad


#: A line of a table as CSV has it (quoted cells may hold line ends), and a cell after its comma.
CSV_LINE, CSV_CELL = r'((?:"[^"]*+"|[^"\n])*+)(?:\n|$)', r',("(?:[^"]++|"")*+"(?=,|$)|[^,]*+)'


def csv_files(files: DataFrame, limit: int = 30) -> DataFrame:
    """A table (frag_id, title, header, rows, total, note, source) of each CSV file (name, raw), with its own header.

    Lines without any text are left out, cells are trimmed, "" within quotes is one quote, and a byte order mark is none of
    the text. At most ``limit`` rows are kept, with a note on how many there are. A file without lines has an empty header.
    """
    cell = lambda c: F.trim(F.when(c.startswith('"') & c.endswith('"') & (F.char_length(c) > 1), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    raw = F.regexp_replace(F.regexp_replace("raw", "\r\n?", "\n"), "^\ufeff", "")
    lines = F.filter(F.regexp_extract_all(raw, F.lit(CSV_LINE), 1), lambda x: F.regexp_replace(x, '[\\s,"]', "") != "")
    cells = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(CSV_CELL), 1), cell))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    none = F.array().cast("array<string>")
    found = files.select("name", stem.alias("title"), F.explode(F.array(cells)).alias("lines"))  # a generator: lines are cut once
    total = F.greatest(F.size("lines") - 1, F.lit(0)).cast("long")
    note = F.when(total > limit, F.concat(F.lit(f"first {limit} of "), total.cast("string"))).otherwise("")
    return found.select(F.concat(F.lit("csv:"), "title").alias("frag_id"), "title", F.coalesce(F.get("lines", F.lit(0)), none).alias("header"), F.slice("lines", 2, limit).alias("rows"), total.alias("total"), note.alias("note"), F.col("name").alias("source"))


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fragments, warnings) of a pack: texts at its root, JSON and CSV files under ``data/``; other files are no sources.

    Files are read whole and routed by their names; Spark's readers pass over files without a single byte. Fragments have frag_id, kind, title, text, data (VARIANT), source.
    """
    texts = _files(spark, path, "*.{md,txt}").select(F.regexp_replace("name", r"\.[^.]*$", "").alias("frag_id"), F.lit("text").alias("kind"), F.lit("").alias("title"), F.col("raw").alias("text"), F.lit(None).cast("variant").alias("data"), F.col("name").alias("source"))
    data = _files(spark, path, "*", "data")
    records, bad = json_files(data.where(F.lower("name").endswith(".json")))
    t = csv_files(data.where(F.lower("name").endswith(".csv")))
    tables = t.select("frag_id", F.lit("table").alias("kind"), "title", F.col("note").alias("text"), F.to_variant_object(F.struct("header", "rows")).alias("data"), "source")
    return texts.unionByName(records).unionByName(tables), bad


def json_fragments(df: DataFrame, stem: str = "data") -> DataFrame:
    """A fragment per top-level key of ``raw``; keys that begin with _ are skipped, a key with : is an id itself."""
    keys = F.json_object_keys("raw")
    each = df.withColumn("key", F.explode(F.filter(keys, lambda k: ~k.startswith("_"))))
    value = F.get(F.map_values(F.map_filter(F.from_json("raw", "map<string,string>"), lambda k, v: k == F.col("key"))), F.lit(0))
    return each.withColumns({"frag_id": F.when(F.col("key").contains(":"), F.col("key")).otherwise(F.concat(F.lit(f"{stem}:"), "key")), "value": value}).drop("key", "raw")


def table_fragments(df: DataFrame, group: str, order: str, cells: list[str], limit: int = 30) -> DataFrame:
    """A table per group as text, at most ``limit`` rows, with a note on how many there are."""
    w = W.partitionBy(group)
    rows = df.select(group, F.concat_ws(" | ", *cells).alias("row"), F.row_number().over(w.orderBy(order)).alias("k"), F.count("*").over(w).alias("total"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "\n")
    found = rows.where(F.col("k") <= limit).groupBy(group).agg(text.alias("table"), F.max("total").alias("total"))
    return found.withColumn("note", F.when(F.col("total") > limit, F.concat(F.lit(f"first {limit} of "), F.col("total").cast("string"))).otherwise(""))


OUTLINES = "outline_id string, slides array<struct<idx:long,archetype:string,title:string,bullets:array<string>>>"
BOX = "box:struct<x:long,y:long,w:long,h:long>"
AUDITS = f"deck_path string, findings array<struct<check_id:string,kind:string,severity:string,slide_idx:long,element_id:string,{BOX},message:string,autofix:string,evidence:map<string,string>>>, checks_run array<string>, duration_s double"
RUNS = (
    "template struct<id:string,sha1:string>, decks array<struct<strategy:string,stats:struct<slides:long,text_items_per_slide:double,words_per_item:double,speech_minutes:double>,"
    "audit:struct<errors:long,warnings:long,info:long,checks_run:long,duration_s:double>,timings_s:map<string,double>>>, timings_s map<string,double>"
)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded documents by their fixed schema: a file is one document, or an array of some, however it is printed."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(outline_id, idx, archetype, title, n_bullets) of recorded outlines."""
    s = _documents(spark, path, OUTLINES).select("outline_id", F.explode_outer("slides").alias("s"))
    return s.select("outline_id", "s.idx", "s.archetype", "s.title", F.size("s.bullets").cast("long").alias("n_bullets"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings of recorded audits, each with its place in its audit (n) and how many checks were run."""
    s = _documents(spark, path, AUDITS).select("deck_path", F.size("checks_run").cast("long").alias("checks_run"), "duration_s", F.posexplode("findings").alias("n", "f"))
    return s.select("deck_path", F.col("n").cast("long").alias("n"), "f.check_id", "f.kind", "f.severity", "f.slide_idx", "f.element_id", "f.box", "f.message", "f.autofix", "f.evidence", "checks_run", "duration_s")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decks, timings) of recorded runs: a row per deck with its statistics and counts of findings, and a row per step with
    its seconds; steps of the whole run have no strategy."""
    r = _documents(spark, path, RUNS)
    decks = r.select(F.col("template.id").alias("template_id"), F.explode("decks").alias("d"))
    found = decks.select("template_id", "d.strategy", "d.stats.*", "d.audit.errors", "d.audit.warnings", "d.audit.info", F.element_at("d.timings_s", F.lit("deck_total")).alias("seconds"))
    steps = decks.select("template_id", "d.strategy", F.explode("d.timings_s").alias("step", "seconds"))
    whole = r.select(F.col("template.id").alias("template_id"), F.lit(None).cast("string").alias("strategy"), F.explode("timings_s").alias("step", "seconds"))
    return found, steps.unionByName(whole)


def select_sources(paths: DataFrame, extensions: tuple[str, ...] = TEXT_EXT) -> DataFrame:
    """Paths of texts outside hidden, built and vendored folders, without licences and package lists."""
    parts = F.split("path", "/")
    dirs, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    skipped = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*SKIP_DIRS) | d.endswith(".egg-info"))
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.lower(name).endswith(e)
    return paths.where(~skipped & ~name.startswith(".") & ~name.rlike(SKIP_NAMES) & ends)


def split_by_cache(inputs: DataFrame, cache: DataFrame, digest: Column) -> DataFrame:
    """Inputs with the prepared result of the same digest, if any; the work folder counts before what is bundled.

    ``cache`` has digest, place ("work" or "bundled") and result.
    """
    best = cache.groupBy("digest").agg(F.min(F.struct(F.when(F.col("place") == "work", 0).otherwise(1).alias("rank"), "result", "place")).alias("best"))
    return inputs.withColumn("digest", digest).join(best, "digest", "left").withColumns({"result": F.col("best.result"), "place": F.coalesce("best.place", F.lit("todo"))}).drop("best")


def write_audit(findings: DataFrame, path: str) -> None:
    """Findings, partitioned by check."""
    findings.write.partitionBy("check_id").parquet(path)


def write_run(findings: DataFrame, slides: DataFrame, strategy: Column, path: str) -> None:
    """What is kept of a run, under ``path``: findings by check, a summary for each deck (summary), and the comparison of
    strategies (comparison)."""
    write_audit(findings, f"{path}/findings")
    counts = findings.sparkSession.read.parquet(f"{path}/findings").groupBy("deck_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")])
    decks = slides.groupBy("deck_id").agg(F.count("*").alias("slides"))
    decks.join(counts, "deck_id", "left").na.fill(0).write.parquet(f"{path}/summary")
    by = slides.select("deck_id", strategy.alias("strategy")).distinct()
    spark = findings.sparkSession
    made = spark.read.parquet(f"{path}/summary").join(by, "deck_id").groupBy("strategy")
    made.agg(F.count("*").alias("decks"), *[F.sum(c).alias(c) for c in ("slides", "n_error", "n_warning", "n_info")]).write.parquet(f"{path}/comparison")
