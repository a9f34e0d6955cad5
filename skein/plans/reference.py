"""The registered queries of the retrieval engine over the driver's tables, each with the SQL that must give the same.

Documents stand for chunks (path source/doc_id.md), benchmark texts for questions, labelled vectors for a vector store.
Query sets of vectors are those whose id is divisible by 100, against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import agent, chunking, context, embed, evaluation, fusion, ignores, lexical, rerank, symbols, vectors
from skein.operators import passages as matching
from skein.operators.cells import Cells
from skein.operators.postings import Postings
from skein.plans import index
from skein.session import scratch
from skein.sources import scan, store
from skein.sources.folders import FolderTracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks. A table that arrives in few files is dealt out before work on its texts begins."""
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    out = docs.select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), path.alias("name"), F.lit("doc").alias("chunk_type"), F.lit(None).cast("string").alias("parent"), F.col("lang").alias("language"), F.col("text").alias("source"))
    want = spark.sparkContext.defaultParallelism
    return out.repartition(want) if docs.rdd.getNumPartitions() < want else out


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, source || '/' || doc_id || '.md' AS file_path, source || '/' || doc_id || '.md' AS name, 'doc' AS chunk_type, CAST(NULL AS VARCHAR) AS parent, lang AS language, text AS source FROM documents)"


_SECRET = " OR ".join(f"contains(text, '{x}')" for x in T.SENSITIVE)


@query(f"SELECT doc_id, sha256(text) AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE NOT ({_SECRET})")
def scan_hash(spark, d):
    """What the scan makes of the bytes of documents: sensitive ones are left out."""
    raw = table(spark, d, "documents").select("doc_id", F.lit("doc").alias("language"), F.col("text").cast("binary").alias("raw"))
    return scan.described(raw).select("doc_id", "file_hash", F.octet_length("content").cast("long").alias("size"))


_EXT = ["py", "ts", "md", "hpp", "JSON", "bin", "Rs", "gitignore"]


def _named(docs: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.pmod("doc_id", F.lit(len(_EXT))) + 1).cast("int"))
    return docs.select("doc_id", F.when(ext == "gitignore", ".gitignore").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("name"))


@query(f"""WITH n AS (SELECT doc_id, {_EXT}[CAST(doc_id % {len(_EXT)} AS INT) + 1] AS e FROM documents),
f AS (SELECT doc_id, CASE WHEN e = 'gitignore' THEN '' ELSE '.' || e END AS ext FROM n)
SELECT doc_id, ext, CASE lower(ext) WHEN '.md' THEN 'doc' WHEN '.json' THEN 'doc' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.hpp' THEN 'cpp' WHEN '.rs' THEN 'rust' END AS language FROM f""")
def detect_language(spark, d):
    ext = T.extension(F.col("name"))
    return _named(table(spark, d, "documents")).select("doc_id", ext.alias("ext"), T.language_of(ext).alias("language"))


@query(r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT page_id, u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1) AS s, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2) AS h, regexp_replace(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '/+$', '') AS p FROM p)
SELECT page_id, CASE WHEN lower(s) IN ('https', 'ssh', 'git+ssh') THEN 'git' WHEN s <> '' THEN 'unsafe' ELSE 'local' END AS kind, lower(s) || '://' || lower(h) || CASE WHEN p = '' THEN '/' ELSE p END AS canonical FROM q""")
def url_classify(spark, d):
    return table(spark, d, "pages").select("page_id", T.git_kind(F.col("url")).alias("kind"), T.canonical_url(F.col("url")).alias("canonical"))


@query(r"""WITH t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^[^/@]+@', ''), '\.git$', '') AS u FROM pages),
s AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(u, '[:/\\.]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS u FROM t)
SELECT page_id, string_split(CASE WHEN u = '' THEN 'repo' ELSE u END, '_')[-1] || '_' || substr(sha256(url), 1, 8) AS dir FROM s""")
def cache_dirs(spark, d):
    return table(spark, d, "pages").select("page_id", T.cache_dir_name(F.col("url")).alias("dir"))


@query("SELECT doc_id FROM documents WHERE NOT (contains(text, 'API_KEY=') OR contains(text, 'SECRET=') OR contains(text, 'TOKEN='))")
def sensitive_filter(spark, d):
    return table(spark, d, "documents").where(~T.is_sensitive(F.col("text"))).select("doc_id")


#: Rule files of the folders that the sources are; rules and paths come from the texts' own words.
_RULES = {"": "*o/\n!s*/\n/src1/**/e*\n# no rule\n\nt*n\n!then*", "src2": "a*/\n!an*/\n**/th", "src3": "[a-h]*\n!?h*", "src0": "*/on\n!th*\nre*/*e"}


@query("""WITH RECURSIVE w AS (SELECT doc_id, source, list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 3) AS w FROM documents),
p AS (SELECT DISTINCT source || '/' || array_to_string(w, '/') AS path FROM w WHERE len(w) > 0),
parts AS (SELECT path AS file, string_split(path, '/') AS a FROM p),
every AS (SELECT DISTINCT array_to_string(a[1:n], '/') AS path, n < len(a) AS is_folder FROM (SELECT a, unnest(range(1, len(a) + 1)) AS n FROM parts)),
rules(folder, line, negated, only_folders, tied, regex) AS (VALUES ('', 0, false, true, false, '[^/]*o'), ('', 1, true, true, false, 's[^/]*'), ('', 2, false, false, true, 'src1/([^/]+/)*e[^/]*'), ('', 5, false, false, false, 't[^/]*n'), ('', 6, true, false, false, 'then[^/]*'),
 ('src2', 0, false, true, false, 'a[^/]*'), ('src2', 1, true, true, false, 'an[^/]*'), ('src2', 2, false, false, true, '([^/]+/)*th'), ('src3', 0, false, false, false, '[a-h][^/]*'), ('src3', 1, true, false, false, '[^/]h[^/]*'),
 ('src0', 0, false, false, true, '[^/]*/on'), ('src0', 1, true, false, false, 'th[^/]*'), ('src0', 2, false, false, true, 're[^/]*/[^/]*e')),
m AS (SELECT e.path, e.is_folder, arg_max(NOT negated, len(folder) * 1000 + line) AS ignored FROM every e JOIN rules r ON (folder = '' OR starts_with(e.path, folder || '/')) AND (NOT only_folders OR is_folder)
 AND regexp_matches(CASE WHEN folder = '' THEN e.path ELSE substr(e.path, length(folder) + 2) END, '^' || CASE WHEN tied THEN '' ELSE '(.*/)?' END || regex || '(/.*)?$') GROUP BY e.path, e.is_folder),
gone AS (SELECT path FROM m WHERE is_folder AND ignored)
SELECT p.path, coalesce(bool_or(m.ignored), false) OR exists(SELECT 1 FROM gone WHERE starts_with(p.path, gone.path || '/')) AS ignored FROM p LEFT JOIN m ON m.path = p.path AND NOT m.is_folder GROUP BY p.path""")
def ignored_paths(spark, d):
    """Paths made of each text's source and first words, under the rules of _RULES."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 3)
    paths = table(spark, d, "documents").select(F.concat_ws("/", "source", F.array_join(words, "/")).alias("path"), F.size(words).alias("n")).where("n > 0").select("path")
    return ignores.ignored(paths, spark.createDataFrame(list(_RULES.items()), "folder string, content string"))


def _symbols(spark, d):
    """Ranges of lines as symbols: a line of a multiple of seven characters begins a class of a thirteenth as many lines, one that
    begins with a vowel a function of a fortieth."""
    lines = chunking.lines(table(spark, d, "documents"), "doc_id", "text").where("text IS NOT NULL AND text <> ''")
    n = F.char_length("text")
    named = lambda kind, size: F.struct(F.lit(kind).alias("kind"), (F.col("line") + F.floor(n / size)).cast("int").alias("end_line"))  # noqa: E731
    both = F.array_compact(F.array(F.when(n % 7 == 0, named("class", 13)), F.when(F.lower(F.left("text", F.lit(1))).isin("a", "e", "i", "o", "u"), named("function", 40))))
    rows = lines.select("doc_id", F.col("line").alias("start_line"), F.substring("text", 1, 12).alias("name"), F.explode(both).alias("s"))
    return rows.select("doc_id", "s.kind", "name", "start_line", "s.end_line")


_SYMBOLS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
c AS (SELECT doc_id, left(l, 12) AS name, CAST(p AS INT) AS s, CAST(p + length(l) // 13 AS INT) AS e FROM l WHERE l <> '' AND length(l) % 7 = 0),
f AS (SELECT doc_id, left(l, 12) AS name, CAST(p AS INT) AS s, CAST(p + length(l) // 40 AS INT) AS e FROM l WHERE l <> '' AND lower(left(l, 1)) IN ('a', 'e', 'i', 'o', 'u')),
j AS (SELECT f.doc_id, f.name, f.s, f.e, c.name AS class_name, c.s AS class_start, row_number() OVER (PARTITION BY f.doc_id, f.s, f.e, f.name ORDER BY c.s DESC, c.e, c.name DESC) AS r FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.s <= f.s AND f.e <= c.e)"""


@query(f"WITH {_SYMBOLS} SELECT doc_id, name, s AS start_line, e AS end_line, class_name, class_start FROM j WHERE r = 1")
def class_members(spark, d):
    return symbols.members(_symbols(spark, d), "doc_id")


@query(f"WITH {_SYMBOLS} SELECT doc_id, class_name, class_start, count(*) AS methods, CAST(sum(e - s + 1) AS BIGINT) AS lines FROM j WHERE r = 1 AND class_name IS NOT NULL GROUP BY ALL")
def class_sizes(spark, d):
    return symbols.class_sizes(_symbols(spark, d), "doc_id")


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"), F.sha2("text", 256).alias("file_hash"), "doc_id")
    old = docs.where("doc_id % 7 <> 1").select("rel_path", "file_hash")
    new = docs.where("doc_id % 5 <> 2").select("rel_path", F.when(F.col("doc_id") % 3 == 0, F.sha2("file_hash", 256)).otherwise(F.col("file_hash")).alias("file_hash"))
    return new, old


_SNAP = "s AS (SELECT source || '/' || doc_id AS rel_path, sha256(text) AS file_hash, doc_id FROM documents), old AS (SELECT rel_path, file_hash FROM s WHERE doc_id % 7 <> 1), cur AS (SELECT rel_path, CASE WHEN doc_id % 3 = 0 THEN sha256(file_hash) ELSE file_hash END AS file_hash FROM s WHERE doc_id % 5 <> 2)"


@query(f"""WITH {_SNAP} SELECT coalesce(cur.rel_path, old.rel_path) AS rel_path, CASE WHEN old.rel_path IS NULL THEN 'added' WHEN cur.rel_path IS NULL THEN 'deleted' ELSE 'modified' END AS status, old.file_hash AS old_hash, cur.file_hash AS new_hash
FROM cur FULL JOIN old ON cur.rel_path = old.rel_path WHERE cur.file_hash IS DISTINCT FROM old.file_hash""")
def change_set(spark, d):
    return store.change_set(*_snapshots(spark, d))


@query(f"""WITH {_SNAP}, c AS (SELECT coalesce(cur.rel_path, old.rel_path) AS p, cur.file_hash AS n, old.file_hash AS o FROM cur FULL JOIN old ON cur.rel_path = old.rel_path)
SELECT CAST(count(*) FILTER (o IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS deleted, CAST(count(*) FILTER (n IS NOT NULL AND o IS NOT NULL AND n <> o) AS BIGINT) AS modified, CAST(count(*) FILTER (n IS DISTINCT FROM o) AS BIGINT) AS total FROM c""")
def change_totals(spark, d):
    return store.change_totals(store.change_set(*_snapshots(spark, d)))


def _deep(spark, d):
    """The two snapshots, with a folder more: three digits of the file's content hash as it was."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", F.left(F.sha2("text", 256), F.lit(2)), F.col("doc_id").cast("string")).alias("rel_path"), F.sha2("text", 256).alias("file_hash"), "doc_id", "source")
    old = docs.where("doc_id % 7 <> 1").select("rel_path", "file_hash")
    new = docs.where("doc_id % 5 <> 2 OR source = 'src1'").select("rel_path", F.when((F.col("doc_id") % 50 == 0) & (F.col("source") != "src1"), F.sha2("file_hash", 256)).otherwise(F.col("file_hash")).alias("file_hash"))
    return new, old


@query("""WITH s AS (SELECT source || '/' || left(sha256(text), 2) || '/' || doc_id AS rel_path, sha256(text) AS file_hash, doc_id, source FROM documents), old AS (SELECT rel_path, file_hash FROM s WHERE doc_id % 7 <> 1),
cur AS (SELECT rel_path, CASE WHEN doc_id % 50 = 0 AND source <> 'src1' THEN sha256(file_hash) ELSE file_hash END AS file_hash FROM s WHERE doc_id % 5 <> 2 OR source = 'src1')
SELECT coalesce(cur.rel_path, old.rel_path) AS rel_path, CASE WHEN old.rel_path IS NULL THEN 'added' WHEN cur.rel_path IS NULL THEN 'deleted' ELSE 'modified' END AS status, old.file_hash AS old_hash, cur.file_hash AS new_hash
FROM cur FULL JOIN old ON cur.rel_path = old.rel_path WHERE cur.file_hash IS DISTINCT FROM old.file_hash""")
def change_set_by_folders(spark, d):
    """Change sets that open only the folders whose hashes differ."""
    new, old = _deep(spark, d)
    tracker = FolderTracker(store.Store(spark, scratch(spark, "store")), "c")
    tracker.write(old)
    return tracker.change_set(new)


def _stored_chunks(spark, d):
    """A collection of every second document, in which files with an id divisible by three are replaced by a later text."""
    kept = store.Store(spark, scratch(spark, "store"), buckets=8)
    own = chunks(spark, d).withColumn("ordinal", F.col("chunk_id")).withColumn("chunk_type", F.col("language")).withColumn("chunk_id", F.concat("file_path", F.lit(":"), F.substring(F.sha2("source", 256), 1, 12)))
    kept.write("docs", own.where("ordinal % 2 = 0"))
    changed = own.where("ordinal % 3 = 0")
    kept.replace_files("docs", changed.select("file_path"), changed.withColumn("source", F.concat(F.lit("new "), "source")))
    return kept


@query(f"WITH {_CHUNKS} SELECT file_path || ':' || substr(sha256(source), 1, 12) AS chunk_id, sha256(CASE WHEN chunk_id % 3 = 0 THEN 'new ' || source ELSE source END) AS source_hash FROM chunks WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0")
def replace_files(spark, d):
    """Chunks of changed files replaced in the buckets of their files."""
    return _stored_chunks(spark, d).read("docs").select("chunk_id", F.sha2("source", 256).alias("source_hash"))


@query("SELECT lang AS chunk_type, count(*) AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY lang")
def merged_statistics(spark, d):
    """Counts by chunk type from the buckets' summaries, after a change of files."""
    return _stored_chunks(spark, d).statistics("docs", "chunk_type").select("chunk_type", "n")


@query(f"WITH {_CHUNKS} SELECT file_path || ':' || substr(sha256(source), 1, 12) AS chunk_id, language, length(source) + CASE WHEN chunk_id % 3 = 0 THEN 4 ELSE 0 END AS n FROM chunks WHERE (chunk_id % 2 = 0 OR chunk_id % 3 = 0) AND language = 'fr'")
def bucket_lookup(spark, d):
    """Columns of given chunks, from the buckets of their files."""
    kept = _stored_chunks(spark, d)
    ids = kept.read("docs").where("language = 'fr'").select("chunk_id")
    return kept.lookup("docs", ids, "language", "source").select("chunk_id", "language", F.char_length("source").cast("long").alias("n"))


@query("SELECT count(*) AS texts, CAST(count(DISTINCT text) AS BIGINT) AS embedded, CAST(0 AS BIGINT) AS again, CAST(count(DISTINCT text) AS BIGINT) AS vectors FROM documents")
def shared_embeddings(spark, d):
    """Vectors by content: how many texts a first collection has embedded, a second of the same texts, and how many are kept."""
    kept = embed.SharedEmbeddings(store.Store(spark, scratch(spark, "store")), 8)
    own = chunks(spark, d).select("chunk_id", "source")
    first, second = kept.add(own, "letters"), kept.add(own, "letters")
    joined = kept.of(own, "letters")
    return joined.agg(F.count("embedding").alias("texts"), F.lit(first).cast("long").alias("embedded"), F.lit(second).cast("long").alias("again"), F.countDistinct(F.sha2("source", 256)).alias("vectors"))


_CHUNK_ID = "file_path || ':' || substr(sha256('doc:' || source || ':1'), 1, 12)"


@query(f"WITH {_CHUNKS} SELECT chunk_id AS doc_id, {_CHUNK_ID} AS chunk_id FROM chunks")
def chunk_ids(spark, d):
    return chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), T.chunk_id(F.col("file_path"), F.col("chunk_type"), F.col("source"), F.lit(1)).alias("chunk_id"))


def _stored(spark, d):
    docs = table(spark, d, "documents")
    key = F.sha2("text", 256).alias("chunk_id")
    cols = [key, "source", F.col("doc_id").alias("ordinal")]
    return docs.where("doc_id % 2 = 0").select(*cols).dropDuplicates(["chunk_id"]), docs.where("doc_id % 3 = 0").select(*cols)


@query("""WITH d AS (SELECT sha256(text) AS chunk_id, source, doc_id AS ordinal FROM documents),
n AS (SELECT chunk_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal) AS r FROM d WHERE ordinal % 3 = 0) WHERE r = 1)
SELECT chunk_id, ordinal AS new_ordinal FROM n UNION ALL SELECT DISTINCT chunk_id, CAST(-1 AS BIGINT) FROM d WHERE ordinal % 2 = 0 AND chunk_id NOT IN (SELECT chunk_id FROM n)""")
def upsert_keep_first(spark, d):
    old, new = _stored(spark, d)
    old = old.select("chunk_id", "source", F.lit(-1).cast("long").alias("ordinal"))
    return store.upserted(old, new).select("chunk_id", F.col("ordinal").alias("new_ordinal"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE file_path NOT IN (SELECT file_path FROM chunks WHERE chunk_id % 4 = 1)")
def delete_by_files(spark, d):
    own = chunks(spark, d)
    return store.without_files(own, own.where("chunk_id % 4 = 1").select("file_path")).select("chunk_id", "file_path")


@query("SELECT lang AS chunk_type, count(*) AS n FROM documents GROUP BY lang")
def chunk_type_stats(spark, d):
    return store.stats(table(spark, d, "documents").withColumnRenamed("lang", "chunk_type"))


@query("SELECT doc_id, CAST(p AS INT) AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)")
def doc_lines(spark, d):
    return chunking.lines(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
s AS (SELECT doc_id, p, l, sum(CASE WHEN length(l) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(p) AS INT) AS first_line, count(*) AS n_lines, CAST(sum(length(l)) AS BIGINT) AS chars FROM s GROUP BY doc_id, section""")
def section_ids(spark, d):
    """Running section numbers; a long line begins a section here (documents have no headings)."""
    numbered = chunking.section_numbers(chunking.lines(table(spark, d, "documents"), "doc_id", "text"), F.length("text") > 200, "doc_id")
    return numbered.groupBy("doc_id", "section").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("chars"))


_TOKENS = r"CAST(coalesce(list_sum(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda x: (length(x) + 5) // 6)), 0) AS INT)"
_TOK = _TOKENS.format
_STRIPPED = r"regexp_replace(b, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) > 200 THEN '## ' || x ELSE x END) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS p FROM d),
n AS (SELECT *, sum(CASE WHEN regexp_matches(l || chr(10), '^#{{1,6}}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM l),
s AS (SELECT doc_id, section, min(p) AS start, string_agg(l, chr(10) ORDER BY p) AS b FROM n GROUP BY doc_id, section),
w AS (SELECT d.doc_id, array_to_string(a, chr(10)) AS t, {_TOK("array_to_string(a, chr(10))")} AS total, (SELECT count(DISTINCT section) FROM s WHERE s.doc_id = d.doc_id) AS sections, (SELECT max(section) FROM s WHERE s.doc_id = d.doc_id) AS last FROM d),
u AS (SELECT doc_id, 0 AS section, 1 AS start, t AS src, length(t) - length(replace(t, chr(10), '')) + 1 AS stop, total > {chunking.MAX_TOKENS} AS cut FROM w WHERE total <= {chunking.MAX_TOKENS} OR sections < 2
UNION ALL SELECT s.doc_id, s.section, s.start, {_STRIPPED}, s.start + length(b) - length(replace(b, chr(10), '')) + CASE WHEN s.section < last THEN 1 ELSE 0 END, {_TOK('b')} > {chunking.MAX_TOKENS} FROM s JOIN w USING (doc_id) WHERE total > {chunking.MAX_TOKENS} AND sections >= 2 AND {_STRIPPED} <> ''),
c AS (SELECT doc_id, section, start, string_split(CASE WHEN ends_with(src, chr(10)) THEN src[:-2] ELSE src END, chr(10)) AS a, ends_with(src, chr(10)) AS ended FROM u WHERE cut),
k AS (SELECT doc_id, section, start, unnest(a) AS l, generate_subscripts(a, 1) AS p, len(a) AS m, ended FROM c),
kt AS (SELECT *, {_TOK('l')} AS n FROM k),
g AS (SELECT doc_id, section, p, n AS total, 1 AS piece FROM kt WHERE p = 1
UNION ALL SELECT kt.doc_id, kt.section, kt.p, CASE WHEN g.total + kt.n > {chunking.MAX_TOKENS} THEN kt.n ELSE g.total + kt.n END, g.piece + CASE WHEN g.total + kt.n > {chunking.MAX_TOKENS} THEN 1 ELSE 0 END FROM g JOIN kt ON kt.doc_id = g.doc_id AND kt.section = g.section AND kt.p = g.p + 1),
pc AS (SELECT kt.doc_id, kt.section, g.piece, min(kt.start + kt.p - 1) AS start, max(kt.start + kt.p - 1) AS stop, sum(n) AS n, string_agg(l, chr(10) ORDER BY kt.p) || CASE WHEN max(kt.p) < max(m) OR bool_or(ended) THEN chr(10) ELSE '' END AS src FROM kt JOIN g USING (doc_id, section, p) GROUP BY kt.doc_id, kt.section, g.piece),
x AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section) AS m FROM pc)
SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, CAST(start AS INT) AS start_line, CAST(stop AS INT) AS end_line, {_TOK('src')} AS token_count, sha256(src) AS source_hash FROM u WHERE NOT cut
UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) || CASE WHEN m > 1 THEN ' [part ' || piece || '/' || m || ']' ELSE '' END, CAST(start AS INT), CAST(stop AS INT), CAST(n AS INT), sha256(src) FROM x""")
def doc_chunks(spark, d):
    """Documents, their long lines made headings, cut by headings, and sections of too many tokens by lines."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) > 200, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    files = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("rel_path"), F.lit("doc").alias("language"), F.sha2("text", 256).alias("file_hash"), marked.alias("content"))
    return chunking.doc_chunks(files).select(F.col("file_path").cast("long").alias("doc_id"), "name", "start_line", "end_line", "token_count", F.sha2("source", 256).alias("source_hash"))


#: A module for each document: {0} is its number.
_MODULE = "import os\nLIMIT = {0}\n\n\nclass Kind{0}:\n    def size(self):\n        return LIMIT\n\n    def half(self):\n        return LIMIT // 2\n\n\ndef main{0}(path):\n    return os.path.join(path, '{0}')\n"


def _module_sql(text: str) -> str:
    return " || doc_id || ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in text.split("{0}"))


_PARTS = (
    ("module_summary", "m{0}.py", 1, 15, None, "# File: m{0}.py\nimport os\nLIMIT = {0}"),
    ("class", "Kind{0}", 5, 10, None, "class Kind{0}:\n    def size(self):\n    def half(self):"),
    ("function", "size", 6, 7, "Kind{0}", "    def size(self):\n        return LIMIT"),
    ("function", "half", 9, 10, "Kind{0}", "    def half(self):\n        return LIMIT // 2"),
    ("function", "main{0}", 13, 14, None, "def main{0}(path):\n    return os.path.join(path, '{0}')"),
)


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS chunk_type, {_module_sql(name)} AS name, {lo} AS start_line, {hi} AS end_line, {_module_sql(parent) if parent else 'CAST(NULL AS VARCHAR)'} AS parent, 'm' || doc_id || '.py:' || substr(sha256('{kind}:' || {_module_sql(body)} || ':{lo}'), 1, 12) AS chunk_id FROM documents"
    for kind, name, lo, hi, parent, body in _PARTS
))
def code_chunks(spark, d):
    """Chunks of a module for each document: summary, class outline, methods and function."""
    number = F.col("doc_id").cast("string")
    path = F.concat(F.lit("m"), number, F.lit(".py"))
    files = table(spark, d, "documents").select(path.alias("rel_path"), F.lit("python").alias("language"), F.lit("").alias("file_hash"), F.replace(F.lit(_MODULE), F.lit("{0}"), number).alias("content"))
    return chunking.chunk_files(files).select(F.regexp_extract("file_path", "[0-9]+", 0).cast("long").alias("doc_id"), "chunk_type", "name", "start_line", "end_line", "parent", "chunk_id")


@query(r"""WITH s AS (SELECT doc_id, source, [x FOR x IN string_split(text, chr(10)) IF x <> ''] AS l, string_split(text, chr(10)) AS a FROM documents),
t AS (SELECT doc_id, source, a, list_filter(a, lambda x: regexp_matches(trim(x), '(?i)^(import\s|from\s|#include\s|using\s|use\s|require\s|package\s)') OR regexp_matches(trim(x), '^[A-Za-z_][A-Za-z0-9_]*\s*[:=]')) AS k FROM s)
SELECT doc_id, sha256('# File: ' || source || chr(10) || trim(array_to_string(CASE WHEN len(k) < 2 THEN a[1:20] ELSE k END, chr(10)), ' ' || chr(10))) AS summary_hash FROM t""")
def module_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.module_summary(F.col("source"), F.col("text")), 256).alias("summary_hash"))


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)"
_NEAR = "n AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, q.label AS ql, v.label AS label, round(list_cosine_distance(q.e, v.e), 6) + 0.0 AS distance FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM n)"


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))


@query(f"WITH {_VEC}, {_NEAR} SELECT query_id, chunk_id, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")
def vector_topk(spark, d):
    v, q = _vectors(spark, d)
    return vectors.vector_topk(v, q, 8)


@query(f"WITH {_VEC}, {_NEAR} SELECT query_id, chunk_id, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8 AND distance <= 0.7")
def vector_max_distance(spark, d):
    v, q = _vectors(spark, d)
    return vectors.vector_topk(v, q, 8, 0.7)


@query(f"""WITH {_VEC}, {_NEAR}, c AS (SELECT *, ql = label AS boosted FROM r WHERE rank <= 50),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS pos, distance <= 0.7 AS near FROM c),
k AS (SELECT *, bool_or(near) OVER (PARTITION BY query_id) AS any_near FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS final_rank FROM k WHERE near OR NOT any_near)
SELECT query_id, chunk_id, distance, boosted, CAST(final_rank AS INT) AS final_rank FROM f WHERE final_rank <= 8""")
def vector_boost_threshold(spark, d):
    v, q = _vectors(spark, d)
    # labels are short: they come back by an equi-join on the few candidates
    near = vectors.vector_topk(v, q, vectors.candidates(8)).join(v.select("chunk_id", "label"), "chunk_id").join(q.select("query_id", "ql"), "query_id")
    return vectors.boost_and_cut(near.withColumn("boosted", F.col("ql") == F.col("label")), F.col("boosted")).select("query_id", "chunk_id", "distance", "boosted", "final_rank")


def _cells(spark, d) -> Cells:
    """The vectors as cells of a collection of their own."""
    index = Cells(store.Store(spark, scratch(spark, "store")), "vectors")
    index.build(_vectors(spark, d)[0])
    return index


@query(f"WITH {_VEC}, {_NEAR} SELECT query_id, chunk_id, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")
def vector_cells_topk(spark, d):
    """Cells are opened until none that remains can hold a nearer vector."""
    return _cells(spark, d).search(_vectors(spark, d)[1], 8, certain=True)


@query(f"WITH {_VEC}, {_NEAR}, f AS (SELECT query_id, chunk_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM n WHERE label % 2 = 1) SELECT * FROM f WHERE rank <= 5")
def vector_cells_filtered(spark, d):
    """The nearest of the vectors whose metadata pass a filter."""
    return _cells(spark, d).search(_vectors(spark, d)[1], 5, where="label % 2 = 1", certain=True)


def vector_cells_approximate(spark, d):
    """As many cells as a sample of the stored vectors needs for 95 of 100 of its nearest."""
    return _cells(spark, d).search(_vectors(spark, d)[1], 8)


QUERIES["vector_cells_approximate"] = vector_cells_approximate  # no SQL: tests hold its recall


def _sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql_keywords(q: str, patterns, stops) -> str:
    every = " || ".join(f"regexp_extract_all({q}, '{p}')" for p in patterns)
    # distinct in order of first place
    low = f"list_transform({every}, lambda w: lower(w))"
    return f"list_filter({low}, lambda w, i: length(w) >= 2 AND w NOT IN {_sql_list(stops)} AND list_position({low}, w) = i)"


_KV = _sql_keywords("text", (T.IDENTIFIER, T.CJK_PAIR, T.FILENAME), T.VECTOR_STOPS)
_KL = _sql_keywords("text", (T.HYPHENATED, T.FILENAME, T.CJK_PAIR), T.LEXICAL_STOPS)


@query(f"SELECT conv_id, turn, array_to_string({_KV}, ' ') AS keywords FROM conversations")
def keywords_vector(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords_vector(F.col("text")), " ").alias("keywords"))


@query(f"SELECT item_id, array_to_string({_KL}, ' ') AS keywords FROM benchmark")
def keywords_lexical(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.keywords_lexical(F.col("text")), " ").alias("keywords"))


_LEX = f"""{_CHUNKS}, k AS (SELECT item_id AS query_id, unnest({_KL}) AS kw FROM benchmark), u AS (SELECT DISTINCT kw FROM k),
l AS (SELECT chunk_id, lower(file_path) AS p, lower(source) AS s, lower(language) AS g FROM chunks),
pt AS (SELECT chunk_id, kw, CASE WHEN contains(p, kw) THEN 9.0 ELSE 0.0 END + least(CAST((length(s) - length(replace(s, kw, ''))) / length(kw) AS INT), 5) * 0.5 + CASE WHEN contains(g, kw) THEN 0.5 ELSE 0.0 END AS points FROM l, u WHERE contains(p, kw) OR contains(s, kw) OR contains(g, kw)),
sc AS (SELECT query_id, chunk_id, CAST(sum(points) AS DOUBLE) AS score FROM pt JOIN k USING (kw) GROUP BY query_id, chunk_id),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


@query(f"WITH {_LEX} SELECT query_id, chunk_id, score FROM sc")
def lexical_scores(spark, d):
    return lexical.lexical_scores(chunks(spark, d), questions(spark, d))


@query(f"WITH {_LEX} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM lr WHERE rank <= 8")
def lexical_topk(spark, d):
    return lexical.lexical_topk(chunks(spark, d), questions(spark, d))


@query(f"WITH {_LEX} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM lr WHERE rank <= 8")
def lexical_postings_topk(spark, d):
    """The lexical channel over kept postings: blocks that cannot reach the k-th score are not read."""
    kept = store.Store(spark, scratch(spark, "store"), buckets=8)
    kept.write("docs", chunks(spark, d))
    own = Postings(kept, "docs")
    own.build()
    return own.topk(questions(spark, d), 8)


_LABEL = "b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM n WHERE ql = label)"


def _rrf_sql(first: str, second: str, names=("vector", "lexical"), w=(1.0, 1.0), k: int = 8) -> str:
    return f"""m AS (SELECT query_id, chunk_id, rank, 0 AS o, '{names[0]}' AS channel, {w[0]} AS w FROM {first} UNION ALL SELECT query_id, chunk_id, rank, 1, '{names[1]}', {w[1]} FROM {second}),
g AS (SELECT query_id, chunk_id, round(CAST(sum(CAST(w AS DOUBLE) / (60 + rank)) AS DOUBLE), 9) AS score, min({{'o': o, 'rank': rank}}) AS f, arg_min(channel, o) AS stage, string_agg(DISTINCT channel, ',' ORDER BY channel DESC) AS channels FROM m GROUP BY query_id, chunk_id),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.o, f.rank, chunk_id) AS rr FROM g)
SELECT query_id, chunk_id, score, stage, channels, CAST(rr AS INT) AS rank FROM x WHERE rr <= {k}"""


def _label_channel(spark, d, k=20):
    """Vectors of the query's label by id, k of each query. A label's first k are its queries' first, so only those are joined."""
    v, q = _vectors(spark, d)
    first = lexical.ranked(v.select("label", "chunk_id").where("label IS NOT NULL"), k, [F.col("chunk_id")], by="label").drop("rank")
    same = q.select("query_id", F.col("ql").alias("label")).join(first, "label")
    return lexical.ranked(same.select("query_id", "chunk_id"), k, [F.col("chunk_id")])


@query(f"WITH {_VEC}, {_NEAR}, {_LABEL}, a AS (SELECT * FROM r WHERE rank <= 20), c AS (SELECT * FROM b WHERE rank <= 20), {_rrf_sql('a', 'c')}")
def rrf_fusion(spark, d):
    v, q = _vectors(spark, d)
    return fusion.rrf({"vector": vectors.vector_topk(v, q, 20), "lexical": _label_channel(spark, d)})


@query(f"WITH {_VEC}, {_NEAR}, {_LABEL}, a AS (SELECT * FROM r WHERE rank <= 20), c AS (SELECT * FROM b WHERE rank <= 20), {_rrf_sql('a', 'c', w=(2.0, 0.5))}")
def rrf_weighted(spark, d):
    v, q = _vectors(spark, d)
    return fusion.rrf({"vector": vectors.vector_topk(v, q, 20), "lexical": _label_channel(spark, d)}, weights={"vector": 2.0, "lexical": 0.5})


def _sql_letters(c: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({c})) - length(replace(lower({c}), '{x}', '')) AS DOUBLE)" for x in embed.LETTERS) + "]"


_TEXTVEC = f"tv AS (SELECT doc_id, {_sql_letters('text')} AS e FROM documents), tq AS (SELECT item_id, {_sql_letters('text')} AS e FROM benchmark), tn AS (SELECT item_id AS query_id, doc_id AS chunk_id, CASE WHEN list_sum(tv.e) = 0 OR list_sum(tq.e) = 0 THEN 1.0 ELSE round(list_cosine_distance(tq.e, tv.e), 6) END + 0.0 AS distance FROM tq, tv), tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM tn)"


def _text_channel(spark, d, k=50):
    own = chunks(spark, d).select("chunk_id", embed.embed(F.col("source"), "letters").alias("embedding"))
    return vectors.vector_topk(own, questions(spark, d).select("query_id", embed.embed(F.col("question"), "letters", True).alias("embedding")), k)


@query(f"WITH {_TEXTVEC} SELECT query_id, chunk_id, distance, CAST(rank AS INT) AS rank FROM tr WHERE rank <= 8")
def text_vector_topk(spark, d):
    return _text_channel(spark, d, 8)


@query(f"""WITH {_CHUNKS}, {_TEXTVEC}, kw AS (SELECT item_id AS query_id, {_KV} AS kws FROM benchmark),
c AS (SELECT tr.*, len(list_filter(kws, lambda w: contains(lower(concat_ws(' ', file_path, name, parent, language)), w))) > 0 AS boosted FROM tr JOIN chunks USING (chunk_id) JOIN kw USING (query_id) WHERE rank <= 50),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS pos, distance <= 0.01 AS near FROM c),
k AS (SELECT *, bool_or(near) OVER (PARTITION BY query_id) AS any_near FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS final_rank FROM k WHERE near OR NOT any_near)
SELECT query_id, chunk_id, distance AS score, CAST(final_rank AS INT) AS rank, 'vector' AS channels, file_path FROM f JOIN chunks USING (chunk_id) WHERE final_rank <= 8""")
def search_vector(spark, d):
    """The vector mode of search(): neighbours, lifted by keywords in their metadata, cut by a threshold with fallback."""
    own = chunks(spark, d).withColumn("embedding", embed.embed(F.col("source"), "letters"))
    return index.search(own, questions(spark, d), "vector", 8, "letters", 0.01).select("query_id", "chunk_id", "score", "rank", "channels", "file_path")


_FALL = "[" + ", ".join(f"'{q}'" for q, _ in agent.FALLBACKS) + "]"
_PREFIXED = f"""tv AS (SELECT doc_id, {_sql_letters("'passage: ' || text")} AS e FROM documents), tq AS (SELECT item_id, {_sql_letters("'query: ' || text")} AS e FROM benchmark),
tn AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(list_cosine_distance(tq.e, tv.e), 6) + 0.0 AS distance FROM tq, tv), tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM tn)"""


@query(f"WITH {_PREFIXED} SELECT query_id, chunk_id, distance, CAST(rank AS INT) AS rank FROM tr WHERE rank <= 8")
def prefixed_vector_topk(spark, d):
    """A profile that puts one prefix before questions and another before documents."""
    own = chunks(spark, d).select("chunk_id", embed.embed(F.col("source"), "letters-e5").alias("embedding"))
    return vectors.vector_topk(own, questions(spark, d).select("query_id", embed.embed(F.col("question"), "letters-e5", True).alias("embedding")), 8)


@query("""WITH b AS (SELECT doc_id, list_transform(range(32), lambda i: CAST(('0x' || substr(sha256(text), 2 * i + 1, 2)) AS INT)) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(32 * list_sum(list_transform(v, lambda x: x * x))) AS n FROM b)
SELECT doc_id, CAST(1024 AS INT) AS dimension, round(v[1] / n, 4) AS first, round(v[32] / n, 4) AS last, round(32 * list_sum(v) / n, 2) AS total FROM n""")
def hash_embeddings(spark, d):
    """The profile of hashed texts: its dimension, ends and sum."""
    v = table(spark, d, "documents").select("doc_id", embed.embed(F.col("text"), "hash").cast("array<double>").alias("v"))
    return v.select("doc_id", F.size("v").alias("dimension"), F.round(F.col("v")[0], 4).alias("first"), F.round(F.element_at("v", -1), 4).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(r"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) > 200 THEN '## ' || x ELSE x END)) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
s AS (SELECT doc_id, p, l, sum(CASE WHEN regexp_matches(l, '^#{1,6}[ 	]+[^ 	

]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(p) AS INT) AS first_line, count(*) AS n_lines FROM s GROUP BY doc_id, section""")
def heading_sections(spark, d):
    """Running section numbers by headings; long lines are made headings before, as documents have none."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) > 200, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    own = table(spark, d, "documents").select("doc_id", marked.alias("text"))
    numbered = chunking.section_numbers(chunking.lines(own, "doc_id", "text"), T.headings(F.col("text")), "doc_id")
    return numbered.groupBy("doc_id", "section").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"))


@query("""SELECT doc_id, '{"' || 'lang' || '":"' || lang || '","' || 'n' || '":"' || n_chars || '"}' AS json, lang AS lang_again, CAST(2 AS INT) AS keys, CAST(0 AS INT) AS keys_of_text FROM documents""")
def json_maps(spark, d):
    """Maps to JSON and back; a text that is no object is an empty map."""
    made = table(spark, d, "documents").select("doc_id", "text", T.json_text(F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"))).alias("json"))
    back = T.json_map(F.col("json"))
    return made.select("doc_id", "json", back["lang"].alias("lang_again"), F.size(back).alias("keys"), F.size(T.json_map(F.col("text"))).alias("keys_of_text"))


_RUNS = f"""f AS (SELECT doc_id, source || '/' || doc_id || '.md' AS rel_path, text FROM documents WHERE NOT ({_SECRET})), a AS (SELECT doc_id, rel_path, sha256(text) AS h FROM f WHERE doc_id % 2 = 0),
b AS (SELECT doc_id, rel_path, sha256(CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'more' ELSE text END) AS h FROM f WHERE doc_id % 3 <> 1)"""


@query(f"""WITH {_RUNS}, c AS (SELECT b.rel_path AS n, a.rel_path AS o, b.h AS nh, a.h AS oh FROM a FULL JOIN b USING (doc_id)),
t AS (SELECT count(*) FILTER (o IS NULL) AS added, count(*) FILTER (n = o AND nh <> oh) AS modified, count(*) FILTER (n IS NULL) AS deleted FROM c)
SELECT rel_path, h AS file_hash, true AS has_chunks, CAST(added AS INT) AS added, CAST(modified AS INT) AS modified, CAST(deleted AS INT) AS deleted, (SELECT count(*) FROM b) AS files FROM b, t""")
def index_runs(spark, d):
    """Two runs of the index over documents as files, of which some come, change and go between them: the tracker, whether its
    files have chunks, what the second run counted, and what the manifest says."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.lit("doc").alias("language"), F.col("text").alias("content"))
    kept = store.Store(spark, scratch(spark, "store"), buckets=8)
    index.index_table(docs.where("doc_id % 2 = 0"), kept, "docs", "letters")
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content"))
    n = index.index_table(docs.where("doc_id % 3 <> 1").withColumn("content", changed), kept, "docs", "letters")
    files = kept.read("docs").select(F.col("file_path").alias("rel_path")).distinct().withColumn("there", F.lit(True))
    told = kept.read("docs", "tracker").join(files, "rel_path", "full_outer").select("rel_path", "file_hash", F.coalesce("there", F.lit(False)).alias("has_chunks"))
    files = index.manifests(spark, kept).first()["files"]
    return told.select("*", *[F.lit(n[k]).cast("int").alias(k) for k in ("added", "modified", "deleted")], F.lit(files).alias("files"))


_STEPS = rf"""o AS (SELECT item_id AS task_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;.
]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS own FROM benchmark),
f AS (SELECT task_id, CASE WHEN len(own) < 3 THEN list_concat(own, list_filter({_FALL}, lambda f: NOT list_contains(own, f)))[1:3] ELSE own[1:6] END AS q FROM o),
st AS (SELECT task_id, CAST(generate_subscripts(q, 1) - 1 AS INT) AS pos, unnest(q) AS text FROM f)"""


@query(f"""WITH {_CHUNKS}, {_STEPS}, k AS (SELECT task_id, pos, unnest({_KL}) AS kw FROM st), u AS (SELECT DISTINCT kw FROM k),
l AS (SELECT chunk_id, lower(file_path) AS p, lower(source) AS s, lower(language) AS g FROM chunks),
pt AS (SELECT chunk_id, kw, CASE WHEN contains(p, kw) THEN 9.0 ELSE 0.0 END + least(CAST((length(s) - length(replace(s, kw, ''))) / length(kw) AS INT), 5) * 0.5 + CASE WHEN contains(g, kw) THEN 0.5 ELSE 0.0 END AS points FROM l, u WHERE contains(p, kw) OR contains(s, kw) OR contains(g, kw)),
sc AS (SELECT task_id, pos, chunk_id, CAST(sum(points) AS DOUBLE) AS score FROM pt JOIN k USING (kw) GROUP BY task_id, pos, chunk_id),
lr AS (SELECT *, row_number() OVER (PARTITION BY task_id, pos ORDER BY score DESC, chunk_id) AS rank FROM sc),
ev AS (SELECT task_id, pos, rank, file_path FROM lr JOIN chunks USING (chunk_id) WHERE rank <= 3),
fi AS (SELECT task_id, file_path, count(DISTINCT pos) AS steps, min({{'p': pos, 'r': rank}}) AS f FROM ev GROUP BY task_id, file_path),
kf AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY steps DESC, f.p, f.r, file_path) AS r FROM fi),
n AS (SELECT task_id, max(len(q)) AS steps FROM f GROUP BY task_id), a AS (SELECT task_id, string_agg(file_path, ',' ORDER BY r) AS key_files FROM kf WHERE r <= 8 GROUP BY task_id)
SELECT n.task_id, CAST(steps AS INT) AS steps, coalesce(key_files, '') AS key_files, key_files IS NULL AS insufficient_evidence FROM n LEFT JOIN a USING (task_id)""")
def agent_evidence(spark, d):
    """Plans of all benchmark texts as tasks, evidence of all their steps in one batch, and the files that briefs name."""
    tasks = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))
    steps, _, briefs = index.run_agents(chunks(spark, d), tasks, "lexical", k=3)
    told = briefs.select("task_id", F.array_join("key_files", ",").alias("key_files"), "insufficient_evidence")
    return steps.groupBy("task_id").agg(F.count("*").cast("int").alias("steps")).join(told, "task_id")


_WORDS_OF = f"kw AS (SELECT item_id AS query_id, {_KV} AS kws FROM benchmark)"


@query(f"""WITH {_LEX}, {_TEXTVEC}, {_WORDS_OF},
c AS (SELECT tr.*, len(list_filter(kws, lambda w: contains(lower(concat_ws(' ', file_path, name, parent, language)), w))) > 0 AS boosted FROM tr JOIN chunks USING (chunk_id) JOIN kw USING (query_id) WHERE rank <= 250),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS pos, distance <= 0.01 AS near FROM c),
kn AS (SELECT *, bool_or(near) OVER (PARTITION BY query_id) AS any_near FROM p),
fc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS final_rank FROM kn WHERE near OR NOT any_near),
ha AS (SELECT query_id, chunk_id, final_rank AS rank FROM fc WHERE final_rank <= 50), hb AS (SELECT query_id, chunk_id, rank FROM lr WHERE rank <= 50), {_rrf_sql('ha', 'hb').replace('SELECT query_id, chunk_id, score, stage, channels, CAST(rr AS INT) AS rank FROM x WHERE rr <= 8', 'SELECT query_id, x.chunk_id, score, stage, channels, CAST(rr AS INT) AS rank, file_path FROM x JOIN chunks ON chunks.chunk_id = x.chunk_id WHERE rr <= 8')}""")
def search_hybrid(spark, d):
    """The hybrid mode of search(): both channels as it fetches them, fused by reciprocal ranks."""
    own = chunks(spark, d).withColumn("embedding", embed.embed(F.col("source"), "letters"))
    return index.search(own, questions(spark, d), "hybrid", 8, "letters", 0.01).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "stage", "channels", "rank", "file_path")


@query(f"""WITH RECURSIVE {_VEC}, {_NEAR}, c AS (SELECT query_id, chunk_id, rank, round(1 - distance, 6) AS near FROM r WHERE rank <= 30),
s AS (SELECT c.query_id, c.chunk_id, o.chunk_id AS other, round(1 - list_cosine_distance(a.e, b.e), 6) AS alike FROM c JOIN c o ON o.query_id = c.query_id JOIN v a ON a.vec_id = c.chunk_id JOIN v b ON b.vec_id = o.chunk_id),
m AS (SELECT query_id, chunk_id, rank, near, CAST(0 AS DOUBLE) AS alike, 0 AS step, CAST(NULL AS BIGINT) AS pick, CAST(0 AS DOUBLE) AS value, false AS gone FROM c
UNION ALL SELECT query_id, chunk_id, rank, near, CASE WHEN step = 0 THEN seen ELSE greatest(alike, seen) END, step + 1, pick, value, gone OR chunk_id = pick FROM (
  SELECT f.query_id, f.chunk_id, f.rank, f.near, f.alike, f.step, f.gone, f.p.c AS pick, f.p.v AS value, s.alike AS seen
  FROM (SELECT *, max({{'v': CASE WHEN gone THEN -9.0 ELSE round(0.6 * near - 0.4 * alike, 6) END, 'r': -rank, 'c': chunk_id}}) OVER (PARTITION BY query_id) AS p FROM (SELECT query_id, chunk_id, rank, near, alike, step, gone FROM m WHERE step < 6)) f
  JOIN s ON s.query_id = f.query_id AND s.chunk_id = f.chunk_id AND s.other = f.p.c))
SELECT DISTINCT query_id, pick AS chunk_id, value AS score, CAST(step AS INT) AS rank FROM m WHERE step > 0""")
def diverse_topk(spark, d):
    """Hits of the vector channel, chosen one by one for nearness and for distance from those chosen before."""
    v, q = _vectors(spark, d)
    return vectors.vector_topk(v, q, 30).transform(rerank.diverse(v, q, 6, 0.6))


_HYBRID = f"{_LEX}, {_TEXTVEC}, ha AS (SELECT * FROM tr WHERE rank <= 50), hb AS (SELECT * FROM lr WHERE rank <= 50)"


def _hybrid(spark, d, k=8):
    return fusion.rrf({"vector": _text_channel(spark, d), "lexical": lexical.lexical_topk(chunks(spark, d), questions(spark, d), 50)}, k)


@query(f"WITH {_HYBRID}, {_rrf_sql('ha', 'hb')}")
def hybrid_topk(spark, d):
    return _hybrid(spark, d)


def _golden(spark, d):
    """A vector's file is its label; queries whose id is divisible by 200 expect their label, the others nothing."""
    v, q = _vectors(spark, d)
    label = F.concat(F.lit("label_"), F.col("ql").cast("string"), F.lit(".py"))
    none = F.array().cast("array<string>")
    golden = q.select("query_id", F.when(F.col("query_id") % 200 == 0, F.array(label)).otherwise(none).alias("expected_files"), F.when(F.col("query_id") % 400 == 0, F.array(F.col("query_id").cast("string"))).otherwise(none).alias("expected_symbols"))
    meta = v.select("chunk_id", F.concat(F.lit("src\\Label_"), F.col("label").cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("s"), F.col("chunk_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("parent"))
    return golden, vectors.vector_topk(v, q, 9).where("query_id <> chunk_id").join(meta, "chunk_id"), meta


_GOLD = f"""{_VEC}, {_NEAR}, h AS (SELECT *, rank AS hr FROM r WHERE rank <= 9 AND query_id <> chunk_id),
gq AS (SELECT vec_id AS query_id, label AS ql, vec_id % 200 = 0 AS has_files, vec_id % 400 = 0 AS has_symbols FROM q),
j AS (SELECT gq.*, h.rank, h.chunk_id, coalesce(has_files AND contains('src/label_' || h.label || '.py', 'label_' || gq.ql || '.py'), false) AS fh, coalesce(has_symbols AND contains('s' || h.chunk_id, CAST(gq.query_id AS VARCHAR)), false) AS sh FROM gq LEFT JOIN h ON h.query_id = gq.query_id),
pq AS (SELECT query_id, CAST(min(CASE WHEN fh OR sh THEN rank END) AS INT) AS first_hit_rank, bool_or(fh) AS file_hit, bool_or(sh) AS symbol_hit, bool_or(has_files) AS has_files, bool_or(has_symbols) AS has_symbols, count(rank) AS n_hits FROM j GROUP BY query_id),
pm AS (SELECT *, CAST(coalesce(first_hit_rank <= 1, false) AS INT) AS recall_at_1, CAST(coalesce(first_hit_rank <= 3, false) AS INT) AS recall_at_3, CAST(coalesce(first_hit_rank <= 8, false) AS INT) AS recall_at_8, coalesce(1.0::DOUBLE / first_hit_rank, 0.0::DOUBLE) AS rr FROM pq)"""
_SUMMARY = "count(*) AS total, count(*) FILTER (has_files OR has_symbols) AS scored, " + ", ".join(
    f"round(coalesce(avg(CAST({c} AS DOUBLE)) FILTER ({w}), 0.0), 9) AS {n}"
    for c, w, n in [(f"recall_at_{k}", "has_files OR has_symbols", f"recall_at_{k}") for k in (1, 3, 8)] + [("rr", "has_files OR has_symbols", "mrr"), ("CAST(file_hit AS INT)", "has_files", "file_hit_rate"), ("CAST(symbol_hit AS INT)", "has_symbols", "symbol_hit_rate")]
)


@query(f"WITH {_GOLD} SELECT * REPLACE (coalesce(first_hit_rank, 0) AS first_hit_rank) FROM pm")
def golden_per_query(spark, d):
    golden, hits, _ = _golden(spark, d)
    return evaluation.per_query(golden, hits).withColumn("first_hit_rank", F.coalesce("first_hit_rank", F.lit(0)))  # 0: no hit


@query(f"WITH {_GOLD} SELECT {_SUMMARY} FROM pm")
def golden_summary(spark, d):
    golden, hits, _ = _golden(spark, d)
    return evaluation.summary(evaluation.per_query(golden, hits))


_MODES = f"""WITH {_LEX}, {_TEXTVEC}, hits AS (SELECT 'lexical' AS mode, query_id, chunk_id, rank FROM lr WHERE rank <= 8 UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM tr WHERE rank <= 8),
ex AS (SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)),
gq AS (SELECT item_id AS query_id, list(source || '/' || documents.doc_id || '.md') FILTER (ex.doc_id IS NOT NULL) AS files FROM benchmark LEFT JOIN ex USING (item_id) LEFT JOIN documents ON documents.doc_id = ex.doc_id GROUP BY item_id),
j AS (SELECT m.mode, gq.query_id, h.rank, files IS NOT NULL AS has_files, false AS has_symbols, coalesce(len(list_filter(files, lambda f: contains(c.file_path, f))) > 0, false) AS fh FROM gq CROSS JOIN (SELECT DISTINCT mode FROM hits) m LEFT JOIN hits h ON h.query_id = gq.query_id AND h.mode = m.mode LEFT JOIN chunks c ON c.chunk_id = h.chunk_id),
pq AS (SELECT mode, query_id, min(CASE WHEN fh THEN rank END) AS f, bool_or(fh) AS file_hit, false AS symbol_hit, bool_or(has_files) AS has_files, false AS has_symbols FROM j GROUP BY mode, query_id),
pm AS (SELECT *, coalesce(f <= 1, false)::INT AS recall_at_1, coalesce(f <= 3, false)::INT AS recall_at_3, coalesce(f <= 8, false)::INT AS recall_at_8, coalesce(1.0::DOUBLE / f, 0.0::DOUBLE) AS rr FROM pq)
SELECT mode, {_SUMMARY} FROM pm GROUP BY mode"""


def passages(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id where a document holds a benchmark item word for word."""
    own = chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.col("source").alias("text"))
    return matching.passages(table(spark, d, "benchmark").select("item_id", F.col("text").alias("item")), own)


@query(_MODES)
def compare_modes(spark, d):
    q, own = questions(spark, d), chunks(spark, d)
    hits = lexical.lexical_topk(own, q).select(F.lit("lexical").alias("mode"), "query_id", "chunk_id", "rank").unionByName(_text_channel(spark, d, 8).select(F.lit("vector").alias("mode"), "query_id", "chunk_id", "rank"))
    hits = hits.join(own.select("chunk_id", "file_path", "name", "parent"), "chunk_id")
    paths = passages(spark, d).join(own.select(F.col("chunk_id").alias("doc_id"), "file_path"), "doc_id").groupBy("item_id").agg(F.collect_list("file_path").alias("f"))
    none = F.array().cast("array<string>")
    golden = q.join(paths, q["query_id"] == paths["item_id"], "left").select("query_id", F.coalesce("f", none).alias("expected_files"), none.alias("expected_symbols"))
    return evaluation.summary(evaluation.per_query(golden, hits, ["mode"]), ["mode"])


@query("SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def golden_passages(spark, d):
    return passages(spark, d)


@query(f"""WITH {_VEC}, {_NEAR}, t AS (SELECT query_id, rank, distance AS score, CASE WHEN label % 3 = 0 THEN 'doc' ELSE 'function' END AS chunk_type FROM r WHERE rank <= 2 AND query_id % 300 <> 0),
g AS (SELECT vec_id AS query_id, count(rank) AS n, sum(CASE WHEN chunk_type <> 'doc' THEN 1 ELSE 0 END) AS code, avg(score) AS m FROM q LEFT JOIN t ON t.query_id = q.vec_id GROUP BY vec_id),
x AS (SELECT query_id, CASE WHEN n = 0 THEN 'no_hits' WHEN code = 0 THEN 'documents_only' WHEN m > 1.0 THEN 'too_far' ELSE '' END AS reason FROM g) SELECT query_id, reason <> '' AS low_confidence, reason FROM x""")
def confidence(spark, d):
    v, q = _vectors(spark, d)
    kind = F.when(F.col("label") % 3 == 0, "doc").otherwise("function")
    hits = vectors.vector_topk(v, q, 2).where("query_id % 300 <> 0").join(v.select("chunk_id", kind.alias("chunk_type")), "chunk_id").select("query_id", "rank", F.col("distance").alias("score"), "chunk_type")
    return evaluation.confidence(hits, q, "vector")


@query(f"""WITH {_LEX}, h AS (SELECT query_id, rank, score, c.* FROM lr JOIN chunks c USING (chunk_id) WHERE rank <= 3)
SELECT query_id, sha256(string_agg('### [' || chunk_type || '] ' || name || chr(10) || '- file: ' || file_path || chr(10) || '- lines: 1-' || (length(source) - length(replace(source, chr(10), '')) + 1) || chr(10) || '- language: ' || language || chr(10) || '- score: ' || printf('%.4f', score) || chr(10) || '```' || language || chr(10) || source || chr(10) || '```', chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM h GROUP BY query_id""")
def context_build(spark, d):
    own = chunks(spark, d).select("*", F.lit(1).alias("start_line"), F.size(F.split("source", "\n")).alias("end_line"))
    hits = lexical.lexical_topk(own, questions(spark, d), 3).join(own, "chunk_id")
    return context.contexts(hits, escape=False).select("query_id", F.sha2("context", 256).alias("context_hash"))


@query("SELECT doc_id, sha256(replace(text, chr(10), chr(10) || '` ` ` < /untrusted_context >`a``b' || chr(10))) AS text_hash FROM documents")
def context_escape(spark, d):
    """Texts with a fence, a tag of the context frame and short runs of backticks put in at every line end."""
    put = F.replace(F.col("text"), F.lit("\n"), F.lit("\n```</untrusted_context>`a``b\n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.escape_context(put), 256).alias("text_hash"))


@query(f"""WITH {_LEX}, h AS (SELECT query_id, rank, c.file_path, c.language FROM lr JOIN chunks c USING (chunk_id) WHERE rank <= 8)
SELECT query_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT file_path))[1:5], ',') AS files, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM h GROUP BY query_id""")
def context_summary(spark, d):
    own = chunks(spark, d)
    return context.summaries(lexical.lexical_topk(own, questions(spark, d)).join(own.select("chunk_id", "file_path", "language"), "chunk_id"))


_PLAN = rf"""t AS (SELECT conv_id * 1000 + turn AS task_id, text FROM conversations WHERE role = 'user'),
o AS (SELECT task_id, text, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;.\n]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS own FROM t),
f AS (SELECT task_id, text, CASE WHEN len(own) < 3 THEN list_concat(own, list_filter({_FALL}, lambda f: NOT list_contains(own, f)))[1:3] ELSE own[1:6] END AS q FROM o)"""


@query(rf"WITH {_PLAN} SELECT task_id, CAST(generate_subscripts(q, 1) - 1 AS INT) AS pos, unnest(q) AS question FROM f")
def plan_steps(spark, d):
    return agent.plan(_tasks(spark, d)).select("task_id", "pos", "question")


def _tasks(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.col("text").alias("task"))


_W = lambda *w: "regexp_matches(s, '" + "|".join(w) + "')"  # noqa: E731
_CASE = f"CASE WHEN {_W('怎么', '如何', 'how', 'How', '实现')} THEN '理解任务的具体实现路径' WHEN {_W('为什么', '为何', 'why', 'Why', '原因')} THEN '解释问题背后的设计 / 决策原因' WHEN {_W('哪些', '哪里', '哪个', 'what', 'What', '文件', '函数')} THEN '定位到具体文件 / 符号' ELSE '用户任务中的一个独立子目标' END"


@query(f"WITH {_PLAN}, e AS (SELECT task_id, unnest(own) AS s FROM o) SELECT rationale, count(*) AS n FROM (SELECT {_CASE} AS rationale FROM e) GROUP BY rationale")
def plan_rationales(spark, d):
    own = _tasks(spark, d).select(F.explode(T.sentences(F.col("task"))).alias("s"))
    return own.select(T.rationale(F.col("s")).alias("rationale")).groupBy("rationale").agg(F.count("*").alias("n"))


@query(f"WITH {_PLAN} SELECT task_id, '用户任务：' || CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 80 THEN substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 77) || '...' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END || '（拆解为 ' || len(q) || ' 个子问题）' AS understanding FROM f")
def plan_understanding(spark, d):
    return agent.plan(_tasks(spark, d)).where("pos = 0").select("task_id", "understanding")


def _evidence(spark, d):
    """Questions as steps of ten tasks, with the files of their lexical hits."""
    own = chunks(spark, d)
    hits = lexical.lexical_topk(own, questions(spark, d), 5)
    files = hits.join(own.select("chunk_id", "language"), "chunk_id")
    return files.select((F.col("query_id") % 10).alias("task_id"), F.floor(F.col("query_id") / 10).alias("pos"), "rank", F.concat("language", F.lit("/"), (F.col("chunk_id") % 20).cast("string")).alias("file_path"))


_EV = f"{_LEX}, ev AS (SELECT query_id % 10 AS task_id, query_id // 10 AS pos, rank, c.language || '/' || chunk_id % 20 AS file_path FROM lr JOIN chunks c USING (chunk_id) WHERE rank <= 5), fi AS (SELECT task_id, file_path, count(DISTINCT pos) AS steps, min({{'p': pos, 'r': rank}}) AS f FROM ev GROUP BY task_id, file_path)"


@query(f"WITH {_EV}, kf AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY steps DESC, f.p, f.r, file_path) AS rank FROM fi) SELECT task_id, file_path, steps, CAST(rank AS INT) AS rank FROM kf WHERE rank <= 8")
def key_files(spark, d):
    return agent.key_files(_evidence(spark, d))


@query(f"WITH {_EV} SELECT task_id, string_agg(file_path, ',' ORDER BY f.p, f.r, file_path) AS refs FROM fi GROUP BY task_id")
def references(spark, d):
    return agent.references(_evidence(spark, d))


@query("""WITH p AS (SELECT DISTINCT source FROM documents), m AS (SELECT source, count(*) AS total_chunks, count(DISTINCT lang) AS languages, max(n_chars) AS largest FROM documents WHERE doc_id % 2 = 0 AND source <> 'src3' GROUP BY source)
SELECT p.source AS collection, CASE WHEN m.source IS NULL THEN 'missing' ELSE 'indexed' END AS status, coalesce(total_chunks, 0) AS total_chunks, coalesce(languages, 0) AS languages, coalesce(largest, 0) AS largest FROM p LEFT JOIN m ON m.source = p.source""")
def manifest_status(spark, d):
    docs = table(spark, d, "documents")
    made = docs.where("doc_id % 2 = 0 AND source <> 'src3'").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("total_chunks"), F.countDistinct("lang").alias("languages"), F.max("n_chars").alias("largest"))
    return store.manifest_status(docs.select(F.col("source").alias("collection")), made)


@query("SELECT page_id, CASE WHEN length(url) > 60 THEN '...' || right(url, 57) ELSE url END AS shown FROM pages")
def display_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.shortened(F.col("url")).alias("shown"))


@query(f"WITH {_GOLD} SELECT query_id, first_hit_rank IS NULL AS no_hit FROM pq WHERE (has_files OR has_symbols) AND NOT file_hit AND NOT symbol_hit ORDER BY query_id LIMIT 5")
def failed_samples(spark, d):
    golden, hits, _ = _golden(spark, d)
    return evaluation.failed_samples(evaluation.per_query(golden, hits)).select("query_id", F.col("first_hit_rank").isNull().alias("no_hit"))


_UNDERSTOOD = f"regexp_matches(text, '{'|'.join(agent.CHANGE_WORDS)}')"
_FAST = f"len(list_filter(q, lambda s: regexp_matches(lower(s), '{'|'.join(agent.SPEED_WORDS)}'))) > 0"


@query(f"""WITH {_PLAN}, w AS (SELECT task_id, q, substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 77) AS text, (task_id // 1000) % 3 AS n FROM f)
SELECT task_id, len(q) AS n_changes, array_to_string(list_transform(range(1, n + 1), lambda i: 'c/' || i), ',') AS key_files,
concat_ws(' ', CASE WHEN n = 0 THEN '{agent.RISK_NONE}' WHEN n < 2 THEN '{agent.RISK_FEW}' END, CASE WHEN {_UNDERSTOOD} THEN '{agent.RISK_CHANGE}' END) AS risks,
1 + CAST({_FAST} AS INT) AS n_tests, n = 0 AS insufficient_evidence, CASE WHEN n = 0 THEN '{agent.NOTE_NONE}' ELSE '{agent.NOTE_FOUND}' END AS review_note FROM w""")
def agent_briefs(spark, d):
    """Briefs of all tasks; a task's evidence is as many files as its conversation's number leaves after division by three."""
    tasks = _tasks(spark, d)
    count = (F.floor(F.col("task_id") / 1000) % 3).cast("int")
    files = tasks.select("task_id", F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("rank")).select("task_id", F.lit(0).alias("pos"), "rank", F.concat(F.lit("c/"), F.col("rank").cast("string")).alias("file_path"))
    found = agent.briefs(agent.plan(tasks), files)
    return found.select("task_id", F.size("suggested_changes").alias("n_changes"), F.array_join("key_files", ",").alias("key_files"), F.array_join("risks", " ").alias("risks"), F.size("suggested_tests").alias("n_tests"), "insufficient_evidence", "review_note")
