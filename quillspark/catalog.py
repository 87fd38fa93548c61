"""Named queries over the driver's tables and the SQL each is compared with.

The tables hold no papers, so each operator runs on an analog: conversations are papers and their turns
versions, orders are papers and their lines citations, events are requests or results, pages and
documents are archives.
"""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import citations, ledger, metadata, throttle, versions
from .session import ship_package
from .sources import archives, tables
from .streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as versions of papers: turn 0 is version 1."""
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("version"), "role", "text")


def good():
    return F.length("text") % 5 != 0


GOOD_SQL = "length(text) % 5 <> 0"
TURNS_SQL = "SELECT conv_id, CAST(turn + 1 AS INTEGER) AS version, role, text FROM conversations"
PREFIX_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY version) AS k FROM ({TURNS_SQL}) WHERE {GOOD_SQL} AND version <= 50) WHERE k = version"


@query("SELECT printf('2406.%05d', i) AS base_id FROM range(4361, 9361) t(i)")
def id_range(spark, sf_dir):
    """The dense key range."""
    return tables.key_range(spark, 4361, 9360, "2406")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 100")
def id_slice(spark, sf_dir):
    """An offset and a limit, as the slicing operator has them."""
    return ledger.slice_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 500)


@query("SELECT page_id, replace(url, '.', '-') AS folder, split_part(url, 'v', 1) AS before_v FROM pages")
def folder_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.folder_key(F.col("url")).alias("folder"), fn.strip_version_at_first_v(F.col("url")).alias("before_v"))


@query(f"""SELECT conv_id, version, id || 'v' || version AS arxiv_id, replace(id, '.', '-') || 'v' || version AS version_folder, id || 'v' || version || '.tar.gz' AS archive,
 'data/' || replace(id, '.', '-') || '/tex/' || replace(id, '.', '-') || 'v' || version AS source_folder, 'http://service/arXiv:' || id AS url FROM (SELECT *, printf('2406.%05d', conv_id) AS id FROM ({TURNS_SQL}))""")
def versioned_id(spark, sf_dir):
    b, v = fn.base_id(F.col("conv_id"), "2406"), F.col("version")
    return turns(spark, sf_dir).select("conv_id", "version", fn.versioned_id(b, v).alias("arxiv_id"), fn.version_folder(b, v).alias("version_folder"), fn.archive_name(b, v).alias("archive"), fn.source_folder("data", b, v).alias("source_folder"), fn.service_url("http://service/arXiv:{}", b).alias("url"))


@query("""SELECT id, regexp_replace(id, 'v[0-9]+$', '') AS strict, split_part(id, 'v', 1) AS compat FROM (VALUES ('2406.04361v2'), ('solv-int/9901001'), ('solv-int/9901001v3'), ('2406.04361'), ('v'), ('')) t(id)""")
def old_style_id(spark, sf_dir):
    """Version suffixes of new and old keys; the compat form also cuts names that hold a v."""
    ids = spark.sql("SELECT * FROM VALUES ('2406.04361v2'), ('solv-int/9901001'), ('solv-int/9901001v3'), ('2406.04361'), ('v'), ('') AS t(id)")
    return ids.select("id", fn.strip_version(F.col("id")).alias("strict"), fn.strip_version_at_first_v(F.col("id")).alias("compat"))


@query(f"SELECT conv_id, version, role FROM ({PREFIX_SQL})")
def version_prefix(spark, sf_dir):
    """Versions up to the first gap."""
    return versions.contiguous_prefix(turns(spark, sf_dir), "conv_id", "version", good()).select("conv_id", "version", "role")


@query(f"""SELECT conv_id, version, role FROM (SELECT *, min(CASE WHEN probe = 'missing' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY version ROWS UNBOUNDED PRECEDING) AS open
 FROM (SELECT k.conv_id, CAST(n.v AS INTEGER) AS version, t.role, CASE WHEN t.text IS NULL OR length(t.text) % 5 = 0 THEN 'missing' WHEN length(t.text) % 3 = 0 THEN 'error' ELSE 'exists' END AS probe
 FROM (SELECT DISTINCT conv_id FROM conversations) k CROSS JOIN range(1, 51) n(v) LEFT JOIN ({TURNS_SQL}) t ON t.conv_id = k.conv_id AND t.version = n.v)) WHERE open = 1 AND probe = 'exists'""")
def version_skip_failed(spark, sf_dir):
    """Versions before the first that is missing; failed ones are skipped."""
    n = F.length("text")
    probe = F.when(n % 5 == 0, "missing").when(n % 3 == 0, "error").otherwise("exists")
    t = turns(spark, sf_dir).withColumn("probe", probe)
    return versions.existing_prefix(t, "conv_id", "version", "probe", F.col("probe") == "exists").select("conv_id", "version", "role")


def _papers(spark, sf_dir) -> DataFrame:
    t = turns(spark, sf_dir)
    day = F.make_timestamp_ltz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    at = F.timestamp_add("DAY", F.col("version"), day) if hasattr(F, "timestamp_add") else day + F.make_interval(days=F.col("version"))
    return t.select(
        F.col("conv_id").cast("string").alias("base_id"), "version", F.when(good(), "exists").otherwise("missing").alias("probe"), F.substring("text", 1, 20).alias("title"),
        F.array("role", F.col("conv_id").cast("string")).alias("authors"), at.alias("published"), F.when(F.col("version") % 2 == 1, at).alias("updated"), F.when(F.col("role") == "user", F.concat(F.lit("J"), F.col("version"))).otherwise("").alias("journal_ref"),
    )


DAY_SQL = "strftime(TIMESTAMP '2024-01-01' + to_days(version), '%Y-%m-%dT%H:%M:%S+00:00')"


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS base_id, arg_max(substr(text, 1, 20), version) AS paper_title, arg_max(role, version) || '|' || CAST(conv_id AS VARCHAR) AS authors,
 arg_min({DAY_SQL}, version) AS submission_date, coalesce(string_agg({DAY_SQL}, '|' ORDER BY version) FILTER (WHERE version % 2 = 1), '') AS revised_dates,
 arg_max('J' || version, version) FILTER (WHERE role = 'user') AS publication_venue, CAST(count(*) AS INTEGER) AS versions FROM ({PREFIX_SQL}) GROUP BY conv_id""")
def metadata_fold(spark, sf_dir):
    """The flagship: the current record of every paper."""
    return metadata.fold_metadata(_papers(spark, sf_dir)).withColumns({"authors": F.array_join("authors", "|"), "revised_dates": F.array_join("revised_dates", "|")})


@query(f"SELECT conv_id, max(version) AS version, arg_max(role, version) AS role FROM ({TURNS_SQL}) GROUP BY conv_id")
def latest_version(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.max("version").alias("version"), F.max_by("role", "version").alias("role"))


@query(f"SELECT conv_id, min(version) AS version, arg_min(role, version) AS role FROM ({TURNS_SQL}) GROUP BY conv_id")
def first_version(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.min("version").alias("version"), F.min_by("role", "version").alias("role"))


@query("SELECT o_custkey, string_agg(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY o_orderkey) AS revised_dates FROM orders GROUP BY o_custkey")
def revised_dates(spark, sf_dir):
    """An ordered list of dates, empty ones left out."""
    dates = F.array_sort(F.collect_list(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))))
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(dates, lambda x: x["at"]).alias("d"))
    return out.select("o_custkey", F.array_join(F.filter("d", lambda x: x != ""), "|").alias("revised_dates"))


@query(f"SELECT conv_id, arg_max(text, version) FILTER (WHERE role = 'assistant' AND text <> '') AS venue FROM ({TURNS_SQL}) GROUP BY conv_id")
def last_non_empty(spark, sf_dir):
    own = F.when((F.col("role") == "assistant") & fn.truthy(F.col("text")).isNotNull(), F.col("version"))
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.max_by("text", own).alias("venue"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.ArXiv'), ''), nullif(json_extract_string(props, '$.k'), '')) AS external_id FROM events WHERE coalesce(nullif(json_extract_string(props, '$.ArXiv'), ''), nullif(json_extract_string(props, '$.k'), '')) IS NOT NULL")
def json_external_id(spark, sf_dir):
    found = fn.first_truthy(F.get_json_object("props", "$.ArXiv"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("external_id")).where("external_id is not null")


_LINES = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
_LAST = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_raw FROM (SELECT *, {_LAST} AS k, CAST(count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS BIGINT) AS n_raw FROM lineitem) WHERE k = 1")
def citation_dedup(spark, sf_dir):
    """Of rows with the same key the last wins."""
    return citations.last_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINES, ["l_partkey", "l_suppkey"])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS base_id, CAST(count(DISTINCT l_linenumber) AS INTEGER) AS \"references\" FROM lineitem GROUP BY l_orderkey")
def citation_count(spark, sf_dir):
    """Distinct cited keys of each paper."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("base_id"), F.col("l_linenumber").alias("ref_key")).distinct()
    return citations.count_citations(rows)


@query(f"SELECT conv_id, string_agg(role, '|' ORDER BY version) AS names, CAST(count(*) AS INTEGER) AS n_names FROM ({TURNS_SQL}) GROUP BY conv_id")
def citation_authors(spark, sf_dir):
    """Names out of an ordered list of structs."""
    people = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("version", F.col("role").alias("name")))).alias("authors"))
    return people.select("conv_id", F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("names"), F.size("authors").alias("n_names"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def todo_anti_join(spark, sf_dir):
    return ledger.todo(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS base_id FROM events WHERE event_type <> 'error'")
def processed_set(spark, sf_dir):
    return ledger.succeeded(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("base_id"), (F.col("event_type") != "error").alias("success")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS base_id, c_custkey IS NOT NULL AS success, CASE WHEN c_custkey IS NOT NULL THEN CAST(coalesce(n, 0) AS INTEGER) ELSE 0 END AS versions,
 CASE WHEN c_custkey IS NOT NULL THEN CAST(coalesce(p, 0) AS INTEGER) ELSE 0 END AS "references", CASE WHEN c_custkey IS NULL THEN 'no metadata' END AS error,
 CASE WHEN c_custkey IS NULL THEN 'no metadata' WHEN coalesce(n, 0) = 0 THEN 'no sources' ELSE 'ok' END AS status,
 CASE WHEN c_custkey IS NOT NULL THEN CAST(coalesce(q, 0) AS BIGINT) ELSE 0 END AS original_size, CASE WHEN c_custkey IS NOT NULL THEN CAST(coalesce(q, 0) * 2 AS BIGINT) ELSE 0 END AS extracted_size
 FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey
 LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS p, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def paper_assembly(spark, sf_dir):
    """Metadata required, citations and sources optional, one result row each."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("base_id"), "o_custkey")
    found = orders.join(table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("base_id")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("base_id")).agg(F.count("*").alias("versions"), F.countDistinct("l_partkey").alias("references"), F.sum(F.col("l_quantity").cast("long")).alias("original_size"))
    sources = lines.select("base_id", "versions", "original_size", (F.col("original_size") * 2).alias("extracted_size"))
    return ledger.assemble(orders.select("base_id"), found, lines.select("base_id", "references"), sources)


@query("SELECT source, CAST(count(*) AS BIGINT) AS n_files, CAST(count(*) FILTER (WHERE strlen(text) >= 1024) AS BIGINT) AS n_pass, CAST(coalesce(sum(strlen(text)) FILTER (WHERE strlen(text) >= 1024), 0) AS BIGINT) AS bytes FROM documents GROUP BY source")
def size_gate(spark, sf_dir):
    """Files of 1024 bytes and more pass."""
    size = F.octet_length("text")
    big = size >= archives.LEAST_BYTES
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.count_if(big).alias("n_pass"), F.coalesce(F.sum(F.when(big, size)), F.lit(0)).cast("long").alias("bytes"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.(html|htm)$')")
def extension_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(fn.has_extension(F.regexp_replace("url", "[?#].*$", ""), ".html", ".htm")).select("page_id", "url")


@query("SELECT page_id, starts_with(html, '<!') AS is_markup, FALSE AS gzip FROM pages UNION ALL SELECT -1, FALSE, TRUE")
def magic_sniff(spark, sf_dir):
    """The first two bytes against a signature; one row of gzip bytes is added, as the pages have none."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    zipped = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.unhex(F.lit("1f8b0800")).alias("content"))
    return pages.union(zipped).select("page_id", (F.substring("content", 1, 2) == F.lit(b"<!")).alias("is_markup"), fn.is_gzip(F.col("content")).alias("gzip"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS versions, CAST(sum(strlen(text)) AS BIGINT) AS original_size, CAST(sum(n_chars) AS BIGINT) AS extracted_size FROM documents GROUP BY source")
def size_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("versions"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("original_size"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("extracted_size"))


def _results(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("base_id"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3).cast("int").alias("versions"), (F.col("event_id") % 4).cast("int").alias("references"),
        (F.col("event_id") % 100).alias("original_size"), (F.col("event_id") % 70).alias("extracted_size"), (F.col("user_id") * 10).alias("rss_bytes"), F.col("ts").cast("timestamp").alias("finished_at"),
    )


_STATS_SQL = """SELECT count(*) AS attempted, count(*) FILTER (WHERE ok) AS successful_papers, count(*) FILTER (WHERE NOT ok) AS failed_papers, CAST(coalesce(sum(event_id % 3) FILTER (WHERE ok), 0) AS BIGINT) AS total_versions,
 CAST(coalesce(sum(event_id % 4) FILTER (WHERE ok), 0) AS BIGINT) AS total_references, count(*) FILTER (WHERE ok AND event_id % 4 > 0) AS papers_with_references, CAST(coalesce(sum(event_id % 100), 0) AS BIGINT) AS total_original_size, CAST(coalesce(sum(event_id % 70), 0) AS BIGINT) AS total_extracted_size,
 CAST(coalesce(sum(user_id * 10), 0) AS DOUBLE) / count(*) AS avg_memory, CAST(coalesce(max(user_id * 10), 0) AS BIGINT) AS max_memory, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS total_time FROM (SELECT *, event_type <> 'error' AS ok FROM events)"""


@query(f"""SELECT *, CAST(successful_papers AS DOUBLE) / attempted AS overall_success_rate, CAST(papers_with_references AS DOUBLE) / successful_papers AS reference_success_rate, CAST(total_references AS DOUBLE) / successful_papers AS avg_refs,
 CAST(total_original_size AS DOUBLE) / successful_papers AS avg_original, CAST(total_extracted_size AS DOUBLE) / successful_papers AS avg_extracted, total_time / attempted AS avg_time FROM ({_STATS_SQL})""")
def checkpoint_row(spark, sf_dir):
    """All run statistics in one row."""
    return ledger.run_statistics(_results(spark, sf_dir))


@query("""SELECT event_type, count(*) AS attempted, count(*) FILTER (WHERE value > 50) AS successes, CASE WHEN count(*) FILTER (WHERE value > 50) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (WHERE user_id % 2 = 0) AS DOUBLE) / count(*) FILTER (WHERE value > 50) END AS rate,
 CASE WHEN count(*) FILTER (WHERE value < -1) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) / count(*) FILTER (WHERE value < -1) END AS zero_guarded FROM events GROUP BY event_type""")
def run_stats(spark, sf_dir):
    """Conditional counts and ratios; a zero denominator gives 0."""
    won = F.count_if(F.col("value") > 50)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("attempted"), won.alias("successes"), fn.ratio(F.count_if(F.col("user_id") % 2 == 0), won).alias("rate"), fn.ratio(F.count("*"), F.count_if(F.col("value") < -1)).alias("zero_guarded"))


@query("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS avg_memory, max(value) AS max_memory FROM events GROUP BY event_type")
def mean_max_sample(spark, sf_dir):
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg((total / F.count("*")).alias("avg_memory"), F.coalesce(F.max("value"), F.lit(0.0)).alias("max_memory"))


@query("""SELECT * FROM (SELECT event_id, row_number() OVER o AS seq, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER o AS BIGINT) AS successful_papers, CAST(sum(event_id % 4) OVER o AS BIGINT) AS total_references
 FROM events WINDOW o AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE seq % 10 = 0""")
def checkpoint_totals(spark, sf_dir):
    """Running counters at every tenth result."""
    e = table(spark, sf_dir, "events")
    totals = {"successful_papers": F.when(F.col("event_type") != "error", 1).otherwise(0).cast("long"), "total_references": F.col("event_id") % 4}
    run = ledger.running_totals(e.select("event_id", "event_type", "ts"), F.date_trunc("hour", "ts"), ["ts", "event_id"], totals)
    return ledger.at_checkpoints(run, 10).select("event_id", "seq", "successful_papers", "total_references")


@query("""SELECT event_id, CAST(i * 1200000 + max(a - i * 1200000) OVER (ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS granted FROM (SELECT event_id, epoch_us(ts) AS a, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS i FROM events)""")
def throttle_schedule(spark, sf_dir):
    """When a throttle of one request in 1.2 seconds lets each through."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrived"))
    hour = F.floor(F.col("arrived") / 3_600_000_000)
    return throttle.throttle_schedule(e, "arrived", hour, ["arrived", "event_id"], 1_200_000).select("event_id", "granted")


@query("""SELECT event_id, user_id, attempt, CASE WHEN event_type = 'error' THEN CAST(pow(2, attempt) AS INTEGER) ELSE 0 END AS backoff_s FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events) WHERE attempt <= 4""")
def retry_ledger(spark, sf_dir):
    """Attempts of each key and what each waits."""
    return throttle.attempt_ledger(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "attempt", "backoff_s")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'ok' WHEN event_type = 'error' THEN 'retry' ELSE 'failed' END AS status FROM events) GROUP BY status")
def status_route(spark, sf_dir):
    code = F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "error", 429).otherwise(404)
    return citations.route_status(table(spark, sf_dir, "events").select(code.alias("http_status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed_s, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 / count(*) AS per_item_s FROM events GROUP BY user_id")
def elapsed_per_item(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    spent = fn.seconds_between(F.min("ts"), F.max("ts"))
    return e.groupBy("user_id").agg(spent.alias("elapsed_s"), fn.ratio(spent, F.count("*")).alias("per_item_s"))


@query()
def metadata_json(spark, sf_dir):
    """Metadata documents; their text is compared parsed, in the tests."""
    return metadata.metadata_documents(metadata.fold_metadata(_papers(spark, sf_dir)))


def _archive(name: str, text: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=0) as tar:
        for member, data in ((name, text.encode()), ("readme.txt", b"x"), ("../evil.tex", b"x")):
            info = tarfile.TarInfo(member)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@query("SELECT 'doc-' || doc_id AS path, 'text/MAIN.TEX' AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def archive_members(spark, sf_dir):
    """Each document goes into an archive with members that are not wanted, and comes out alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def pack(frames):
        import pandas as pd

        for f in frames:
            raw = [_archive("text/MAIN.TEX", t) for t in f["text"]]
            yield pd.DataFrame({"path": "doc-" + f["doc_id"].astype(str), "length": [len(r) for r in raw], "content": raw})

    packed = docs.mapInPandas(pack, "path string, length long, content binary")
    return archives.archive_members(packed).select("path", "name", "size")


@query("SELECT user_id, arg_min(event_id, event_id) IS NOT NULL AS seen FROM events GROUP BY user_id")
def resume_stream(spark, sf_dir):
    """Users met in a stream of landed files that is stopped and started again, each once."""
    import tempfile
    import uuid

    ship_package(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quill-")
    own = f"{base}/resume-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).select("event_id", "user_id").write.mode("append").parquet(f"{own}/landed")
        stream = incremental.new_keys(spark, f"{own}/landed", "event_id long, user_id long", "user_id", 1)
        incremental.run_available(stream, lambda b: b.select("user_id"), f"{own}/out", f"{own}/checkpoint")
    return spark.read.parquet(f"{own}/out").select("user_id", F.lit(True).alias("seen"))
