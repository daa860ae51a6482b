"""Registered queries of the evidence engine on the driver's tables, each with its SQL.

``documents``, ``pages`` and ``conversations`` stand in for source trees: a row is a file with a
virtual path.  Every query covers whole tables; a limit appears only where it is the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.globs import glob_pattern
from ..functions.redact import PATTERN_RULES, mask_patterns, sanitize
from ..functions.text import markdown_escape, path_parts, safe_path
from ..operators import collect, fingerprint, grep, inventory, lookup, search, sections
from ..sources.corpus import Corpus
from . import fact_queries  # noqa: F401  registers the queries over structured files and scans
from .registering import QUERIES, SQL, query  # noqa: F401

def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> Corpus:
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return Corpus.from_table(_table(spark, sf, "documents"), path, F.col("text"))


def chats(spark: SparkSession, sf: str) -> Corpus:
    path = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), F.col("role"))
    return Corpus.from_table(_table(spark, sf, "conversations"), path, F.col("text"))


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_FILES = r"""files AS (SELECT 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, regexp_replace(text, '\r\n?', chr(10), 'g') AS content FROM documents)"""
_CHATS = r"""files AS (SELECT 'chat/' || conv_id || '/' || turn || '.' || role AS path, regexp_replace(text, '\r\n?', chr(10), 'g') AS content FROM conversations)"""
_LINES = rf"""parts AS (SELECT path, regexp_split_to_array(content, '{_ENDS}') AS p FROM files WHERE content IS NOT NULL),
cut AS (SELECT path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM parts),
lines AS (SELECT path, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS text FROM cut)"""
_DIRS = """steps AS (SELECT path, string_split(path, '/') AS c FROM files),
above AS (SELECT path AS file, array_to_string(c[:unnest(range(1, len(c)))], '/') AS dir FROM steps),
dirs AS (SELECT DISTINCT dir AS path, string_split(dir, '/')[-1] AS name, array_to_string(string_split(dir, '/')[:-2], '/') AS parent, len(string_split(dir, '/'))::INT AS depth FROM above)"""
_DOC_LINES = f"WITH {_FILES}, {_LINES}"
_DOC_DIRS = f"WITH {_FILES}, {_DIRS}"


def _glob_sql(column: str, globs: list[str]) -> str:
    return f"regexp_full_match({column}, '{'|'.join(map(glob_pattern, globs))}', 's')"


# --- files, directories -----------------------------------------------------


@query(f"WITH {_FILES}, {_LINES} SELECT f.path, strlen(content)::BIGINT AS size, len(c.p)::BIGINT AS line_count, sha256(content) AS digest FROM files f LEFT JOIN cut c USING (path)")
def files_listing(spark, sf):
    return documents(spark, sf).listing


_GLOBS = ["docs/en/**", "docs/*/src1/*.txt", "**/src?/1*.txt"]


@query(f"WITH {_FILES} SELECT path FROM files WHERE {_glob_sql('path', _GLOBS)}")
def glob_any_of(spark, sf):
    return lookup.glob(documents(spark, sf).files, _GLOBS).select("path")


@query(f"WITH {_FILES} SELECT path FROM files WHERE {_glob_sql('path', ['**/1?.txt'])}")
def glob_basename(spark, sf):
    return lookup.glob(documents(spark, sf).files, ["**/1?.txt"]).select("path")


_WANTED = ["docs/en/none/0.txt", "docs/en/src1/1.txt", "docs/fr/src0/0.txt"]


@query(f"WITH {_FILES} SELECT path FROM files WHERE path IN {tuple(_WANTED)} ORDER BY list_position({_WANTED}, path) LIMIT 1")
def find_first_by_priority(spark, sf):
    return lookup.find_first(documents(spark, sf).files.select("path"), _WANTED)


@query(f"{_DOC_DIRS} SELECT * FROM dirs WHERE name IN ('src3', 'en')")
def dirs_by_name(spark, sf):
    return lookup.find_dirs(documents(spark, sf).dirs, ["src3", "en"])


@query(f"{_DOC_DIRS} SELECT path FROM dirs ORDER BY depth, string_split(path, '/') LIMIT 1")
def nearest_root(spark, sf):
    return lookup.nearest_root(documents(spark, sf).dirs).select("path")


@query(f"{_DOC_DIRS} SELECT DISTINCT d.* FROM dirs d JOIN above a ON a.dir = d.path JOIN files f ON f.path = a.file WHERE contains(f.content, 'token')")
def dir_semi_join_files(spark, sf):
    c = documents(spark, sf)
    return lookup.dirs_with_files(c.dirs, c.files.where(F.contains("content", F.lit("token"))))


@query(f"{_DOC_DIRS} SELECT dir, count(*) AS n_files FROM above GROUP BY dir")
def ancestor_rollup(spark, sf):
    return lookup.files_below(documents(spark, sf).files)


@query(f"{_DOC_DIRS} SELECT c.path, c.name, c.parent, c.depth FROM dirs c JOIN dirs p ON p.path = c.parent AND p.name = 'docs' WHERE c.name NOT IN ('de') AND EXISTS (SELECT 1 FROM dirs k WHERE k.parent = c.path AND k.name IN ('src1', 'src2'))")
def child_dirs_not_reserved(spark, sf):
    c = documents(spark, sf)
    return lookup.named_children(c.dirs, "docs", ["de"], ["src1", "src2"]).select("path", "name", "parent", "depth")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS raw FROM pages),
s AS (SELECT page_id, raw, replace(raw, chr(92), '/') AS slashed FROM p), q AS (SELECT *, list_filter(string_split(slashed, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM s)
SELECT page_id, CASE WHEN regexp_matches(raw, '[\x00-\x1f\x7f]') OR starts_with(slashed, '/') OR contains(raw, ':') OR list_contains(parts, '..') OR len(parts) = 0 THEN NULL ELSE array_to_string(parts, '/') END AS path FROM q""")
def safe_paths(spark, sf):
    pages = _table(spark, sf, "pages")
    return pages.select("page_id", safe_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


# --- pattern search ---------------------------------------------------------

THE = grep.Rule("the", r"the [a-z]+")
LICENSE = grep.Rule("license", r"licen[cs]e", label="License")
SECRET = grep.Rule("secret", r"token = ", label="Secret")
BANG = grep.Rule("bang", r"[A-Z]{4,}!!", label="Shouting", case_sensitive=True)


def _grep_sql(rule: grep.Rule, columns: str = "path, line, text AS line_content") -> str:
    flags = "'c'" if rule.case_sensitive else "'i'"
    where = f"regexp_matches(text, '{rule.pattern}', {flags})"
    return f"SELECT '{rule.id}' AS rule_id, {columns}, regexp_extract(text, '{rule.pattern}', 0, {flags}) AS match_text FROM lines WHERE {where}"


_SHOWN = ["rule_id", "path", "line", "line_content", "match_text"]


@query(f"{_DOC_LINES} {_grep_sql(THE)}")
def grep_line(spark, sf):
    return grep.grep(documents(spark, sf).lines, [THE]).select(*_SHOWN)


@query(f"{_DOC_LINES}, m AS (SELECT path, line, regexp_extract_all(text, '{THE.pattern}', 0, 'i') AS ms FROM lines) SELECT path, line, unnest(range(1, len(ms) + 1))::INT AS ordinal, unnest(ms) AS match_text FROM m")
def grep_all_matches(spark, sf):
    rule = grep.Rule("the", THE.pattern, every_match=True)
    return grep.grep(documents(spark, sf).lines, [rule]).select("path", "line", "ordinal", "match_text")


@query(f"{_DOC_LINES} SELECT * FROM ({_grep_sql(THE)}) ORDER BY string_split(path, '/'), line LIMIT {grep.MAX_MATCHES}")
def grep_cap_component_order(spark, sf):
    return grep.capped(grep.grep(documents(spark, sf).lines, [THE]), grep.MAX_MATCHES).select(*_SHOWN)


@query(f"{_DOC_LINES} {_grep_sql(BANG)}")
def grep_case_sensitive(spark, sf):
    return grep.grep(documents(spark, sf).lines, [BANG]).select(*_SHOWN)


_TIERS = [
    grep.Rule("token-in-de", r"token = ", ("docs/de/**",), "Tokens", 0),
    grep.Rule("token-anywhere", r"token = ", ("docs/**",), "Tokens", 1),
    grep.Rule("license-in-none", r"license", ("docs/none/**",), "License", 0),
    grep.Rule("license-anywhere", r"license", ("docs/**",), "License", 1),
]
_TIER_ROWS = " UNION ALL ".join(f"SELECT '{r.label}' AS label, {r.tier} AS tier, rule_id, path, line FROM ({_grep_sql(r)}) WHERE {_glob_sql('path', list(r.globs))}" for r in _TIERS)


@query(f"{_DOC_LINES}, m AS ({_TIER_ROWS}) SELECT * FROM m WHERE tier = (SELECT min(tier) FROM m x WHERE x.label = m.label)")
def grep_tiered_fallback(spark, sf):
    return grep.first_tier(grep.grep(documents(spark, sf).lines, _TIERS)).select("label", "tier", "rule_id", "path", "line")


_BAG = [LICENSE, SECRET, BANG, grep.Rule("word", r"token", label="Secret")]
_BAG_ROWS = " UNION ALL ".join(f"SELECT '{r.label}' AS label, rule_id, path, line FROM ({_grep_sql(r)})" for r in _BAG)


@query(f"{_DOC_LINES} {_BAG_ROWS}")
def rules_table_bag(spark, sf):
    return grep.grep(documents(spark, sf).lines, _BAG).select("label", "rule_id", "path", "line")


@query(f"{_DOC_LINES}, m AS ({_BAG_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY string_split(path, '/'), line) AS n FROM m) SELECT rule_id, count(*) AS n_matches FROM r WHERE n <= {grep.MAX_MATCHES} GROUP BY rule_id")
def rules_table_capped_counts(spark, sf):
    return grep.capped(grep.grep(documents(spark, sf).lines, _BAG), grep.MAX_MATCHES).groupBy("rule_id").agg(F.count("*").alias("n_matches"))


@query(f"WITH {_FILES} SELECT path, contains(content, 'token') AS has_token, contains(lower(content), 'license') AS has_license FROM files")
def substring_gate(spark, sf):
    return documents(spark, sf).files.select("path", F.contains("content", F.lit("token")).alias("has_token"), F.contains(F.lower("content"), F.lit("license")).alias("has_license"))


_FOLDED = r"[.]\n[a-z]+ the [^\n]+"
_NEWLINES = "list_sum(list_transform({0}, lambda x: len(x) - len(replace(x, chr(10), ''))))::INT"


@query(rf"""WITH {_FILES}, m AS (SELECT path, string_split(content, chr(10)) AS rows, regexp_split_to_array(content, '(?im){_FOLDED}') AS between, regexp_extract_all(content, '(?im){_FOLDED}') AS found FROM files),
e AS (SELECT path, rows, between, found, unnest(range(1, len(found) + 1))::INT AS i FROM m),
s AS (SELECT path, rows, found[i] AS hit, 1 + {_NEWLINES.format('between[:i]')} + coalesce({_NEWLINES.format('found[:i - 1]')}, 0) AS line_start FROM e)
SELECT path, line_start, line_start + (len(hit) - len(replace(hit, chr(10), '')))::INT AS line_end, regexp_replace(rows[line_start], '^\s+|\s+$', '', 'g') AS match_text FROM s""")
def grep_multiline(spark, sf):
    return grep.grep_whole(documents(spark, sf).files, _FOLDED, ("docs/**",))


# --- collection -------------------------------------------------------------


@query(f"{_DOC_LINES}, m AS ({_BAG_ROWS}), k AS (SELECT string_split(path, '/')[2] AS lang, label, min((string_split(path, '/'), line)) AS first_at FROM m GROUP BY ALL) SELECT lang, string_agg(label, ', ' ORDER BY first_at, label) AS summary FROM k GROUP BY lang")
def label_first_seen_summary(spark, sf):
    found = grep.grep(documents(spark, sf).lines, _BAG).select(F.element_at(path_parts(F.col("path")), 2).alias("lang"), "label", path_parts(F.col("path")).alias("parts"), "line")
    return collect.joined_first_seen(found, ["lang"], "label", ["parts", "line"])


@query(f"{_DOC_LINES} SELECT count(DISTINCT lower(match_text)) AS n_distinct, count(*) AS n_matches FROM ({_grep_sql(THE)})")
def distinct_match_count(spark, sf):
    return grep.grep(documents(spark, sf).lines, [THE]).agg(F.count_distinct(F.lower("match_text")).alias("n_distinct"), F.count("*").alias("n_matches"))


@query("WITH g AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_brand) SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM g")
def group_count_desc_stable(spark, sf):
    return collect.counted_groups(_table(spark, sf, "part"), "p_brand", ["p_partkey"])


@query("WITH g AS (SELECT lang, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY lang) SELECT lang, array_to_string(s[:8], ', ') AS names, len(s)::BIGINT AS n_names FROM g")
def top8_sorted_names(spark, sf):
    return collect.sorted_names(_table(spark, sf, "documents"), ["lang"], "source", 8)


_GROUPS = [("Metal", ["steel", "brass", "copper", "nickel", "tin"]), ("Size", ["small", "medium", "large"]), ("Finish", ["polished", "brushed", "plated"])]
_CLAIM = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(p_type), '{w}')" for w in words)} THEN '{name}'" for name, words in _GROUPS) + " END"


@query(f"SELECT {_CLAIM} AS grp, count(*) AS n FROM part GROUP BY 1")
def priority_claim_groups(spark, sf):
    return _table(spark, sf, "part").select(collect.claimed_by(F.col("p_type"), _GROUPS).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS resolved FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey")
def alias_resolution_left_join(spark, sf):
    names = _table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("alias"), "n_name")
    rows = _table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("key"))
    return collect.resolved(rows, "key", names, "alias", "n_name").select("s_suppkey", "resolved")


@query("SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey")
def edge_list_no_self_loops(spark, sf):
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    buyers = orders.join(_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = _table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    # each order keeps its distinct nations only, so the join below carries less
    return collect.edges(buyers.join(sold.distinct(), F.col("o_orderkey") == F.col("l_orderkey")), "c_nationkey", "s_nationkey")


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY o_custkey")
def forall_completeness(spark, sf):
    return collect.all_hold(_table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_long, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def conditional_counts(spark, sf):
    return _table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.count_distinct("source").alias("n_sources"))


# --- inventories ------------------------------------------------------------

_FOUND = f"{_DOC_LINES}, m AS (SELECT string_split(path, '/')[2] AS lang, path, line, unnest(range(1, len(ms) + 1))::INT AS ordinal, unnest(ms) AS value FROM (SELECT path, line, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS ms FROM lines)), i AS (SELECT lang, value, min((string_split(path, '/'), line, ordinal)) AS f, count(*) AS n_evidence FROM m GROUP BY lang, value), items AS (SELECT lang, value, n_evidence, row_number() OVER (PARTITION BY lang ORDER BY f, value) - 1 AS ordinal FROM i)"


def _items(spark, sf, most=None):
    rule = grep.Rule("names", r"[A-Z][a-z]{3,}", case_sensitive=True, every_match=True)
    found = grep.grep(documents(spark, sf).lines, [rule])
    found = found.select(F.element_at(path_parts(F.col("path")), 2).alias("lang"), path_parts(F.col("path")).alias("parts"), "line", "ordinal", "match_text")
    return inventory.items(found, ["lang"], "match_text", ["parts", "line", "ordinal"], most)


@query(f"{_FOUND} SELECT lang, ordinal, value, n_evidence FROM items")
def inventory_first_seen(spark, sf):
    return _items(spark, sf).select("lang", "ordinal", "value", "n_evidence")


@query(f"{_FOUND}, n AS (SELECT lang, count(*) AS n FROM items GROUP BY lang) SELECT lang, least(n, 1000)::BIGINT AS n_items, CASE WHEN n > 1000 THEN 'incomplete' ELSE 'complete' END AS completeness, CASE WHEN n > 1000 THEN 'collection limit 1000 reached' END AS stop_reason FROM n")
def inventory_overflow_cap(spark, sf):
    return inventory.with_limit(_items(spark, sf, 1001), ["lang"], 1000)


@query(f"{_FOUND}, n AS (SELECT lang, count(*) AS total FROM items GROUP BY lang) SELECT lang, ordinal, value, total, CASE WHEN 150 < total THEN '150' END AS next_cursor FROM items JOIN n USING (lang) WHERE ordinal >= 50 AND ordinal < 150")
def inventory_page(spark, sf):
    return inventory.page(_items(spark, sf), ["lang"], 50, 100).select("lang", "ordinal", "value", "total", "next_cursor")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def item_semi_join_evidence(spark, sf):
    parts = _table(spark, sf, "part").select("p_partkey")
    returned = _table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return inventory.with_evidence(parts, returned, ["p_partkey"])


# --- sections ---------------------------------------------------------------


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS ordinal, count(*) OVER (PARTITION BY role) AS evidence_total FROM conversations) SELECT * FROM r WHERE ordinal < 25")
def evidence_cap_keep_total(spark, sf):
    chat = _table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sections.capped_evidence(chat, ["role"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "role", "ordinal", "evidence_total")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'label' END AS summary, coalesce(l.quality = 1, d.n_chars > 500) AS detected, l.doc_id IS NOT NULL AS overridden FROM documents d LEFT JOIN labels l USING (doc_id)")
def section_override_merge(spark, sf):
    base = _table(spark, sf, "documents").select("doc_id", F.col("source").alias("summary"), (F.col("n_chars") > 500).alias("detected"))
    other = _table(spark, sf, "labels").select("doc_id", F.lit("label").alias("summary"), (F.col("quality") == 1).alias("detected"))
    return sections.merged(base, other, ["doc_id"], ["summary", "detected"])


_SECTIONS = "s AS (SELECT lang AS layer, source AS section, bool_or(quality = 1 AND toxic = 0) AS detected, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source)"


def _sections(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.col("lang").alias("layer"), F.col("source").alias("section"))
    return docs.join(_table(spark, sf, "labels"), "doc_id").groupBy("layer", "section").agg(F.bool_or((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("detected"), F.count("*").alias("n"))


@query(f"WITH {_SECTIONS} SELECT layer, count(*) AS sections, count(*) FILTER (detected) AS detected FROM s GROUP BY layer")
def layer_rollup(spark, sf):
    return sections.layer_rollup(_sections(spark, sf))


_HIGHLIGHTS = [("en", "src0"), ("fr", "src1"), ("de", "src9"), ("es", "src3"), ("en", "none")]


@query(f"WITH {_SECTIONS}, h AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(_HIGHLIGHTS))}) v(layer, section, rank)) SELECT layer, section, n, rank::INT AS rank FROM s JOIN h USING (layer, section) WHERE detected")
def overview_highlights(spark, sf):
    return sections.highlights(_sections(spark, sf), _HIGHLIGHTS).select("layer", "section", "n", "rank")


@query(f"WITH {_SECTIONS} SELECT layer, section FROM s WHERE NOT coalesce(detected, false)")
def undetected_list(spark, sf):
    return sections.undetected(_sections(spark, sf)).select("layer", "section")


@query(f"""{_DOC_LINES}, e AS (SELECT path, line, line + 1 AS stop, (SELECT len(p) FROM cut c WHERE c.path = l.path) AS total FROM lines l)
SELECT path, count(*) FILTER (stop > total) AS rejected, CASE WHEN count(*) FILTER (stop > total) > 0 THEN 'Omitted ' || count(*) FILTER (stop > total) || ' invalid evidence entries' END AS error FROM e GROUP BY path""")
def evidence_validation(spark, sf):
    c = documents(spark, sf)
    known = c.lines.join(c.listing.select("path", "line_count", "digest"), "path")
    evidence = known.select(
        "path", F.lit("source_lines").alias("provenance"), F.col("line").alias("line_start"), (F.col("line") + 1).alias("line_end"),
        F.col("line_count").alias("source_line_count"), F.col("digest").alias("source_digest"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("property"),
    )
    return sections.rejections(evidence, ["path"])


# --- search -----------------------------------------------------------------

_TOKENS = """runs AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda r: r <> '')) AS run FROM documents),
split AS (SELECT doc_id, lower(run) AS whole, string_split(lower(regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' ') AS p FROM runs),
tokens AS (SELECT doc_id, unnest(CASE WHEN len(p) > 1 THEN [whole] || p ELSE [whole] END) AS term FROM split)"""


@query(f"WITH {_TOKENS} SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term")
def tokenize_tf(spark, sf):
    return search.postings(_table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term")
def document_frequency(spark, sf):
    return search.document_frequency(_table(spark, sf, "documents"), "doc_id", "text")


SEARCHED = "where is the license token erthed"


def _bm25_sql(limit: int | None, detected: str = "false", inside: str = "true") -> str:
    terms = search.query_terms(SEARCHED)
    listed = ", ".join(f"('{t}', {i})" for i, t in enumerate(terms))
    return f"""WITH {_TOKENS}, q AS (SELECT * FROM (VALUES {listed}) v(term, i)),
d AS (SELECT doc_id, lang, coalesce(quality = 1, false) AS labelled FROM documents LEFT JOIN labels USING (doc_id)),
len AS (SELECT doc_id, count(*) AS length FROM tokens GROUP BY doc_id),
stats AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(length, 0)) AS average FROM documents LEFT JOIN len USING (doc_id)),
tf AS (SELECT doc_id, term, i, count(*)::DOUBLE AS tf FROM tokens JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
part AS (SELECT doc_id, i, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({search.K1} + 1) / (tf + {search.K1} * (1 - {search.B} + {search.B} * (length / average))) AS s FROM tf JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN stats),
total AS (SELECT doc_id, sum(s ORDER BY i) AS s, string_agg(term, ' ' ORDER BY i) AS matched_terms FROM part GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN {detected} THEN s * {search.DETECTED_BOOST} ELSE s END, 6) AS score, matched_terms FROM total JOIN d USING (doc_id) WHERE {inside} ORDER BY score DESC, doc_id {f'LIMIT {limit}' if limit else ''}"""


@query(_bm25_sql(10))
def bm25_topk(spark, sf):
    return search.search(_table(spark, sf, "documents"), SEARCHED, ["doc_id"], "text", 10)


@query(_bm25_sql(None, inside="lang = 'fr'"))
def bm25_layer_filter_after_stats(spark, sf):
    return search.search(_table(spark, sf, "documents"), SEARCHED, ["doc_id"], "text", None, where=F.col("lang") == "fr")


@query(_bm25_sql(inventory.SEARCH_MAX, detected="labelled"))
def bm25_detected_boost(spark, sf):
    docs = _table(spark, sf, "documents").join(_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return search.search(docs, SEARCHED, ["doc_id"], "text", inventory.clamped(80, inventory.SEARCH_MAX), detected=F.col("quality") == 1)


# --- text, digests, rendering -----------------------------------------------


def _masked_sql(column: str) -> str:
    for pattern, by in PATTERN_RULES:
        column = f"regexp_replace({column}, '{pattern.replace("'", "''")}', '{by.replace('$1', '\\1').replace("'", "''")}', 'g')"
    return column


@query(f"SELECT doc_id, {_masked_sql('text')} AS safe FROM documents")
def redact_regex_rules(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", mask_patterns(F.col("text")).alias("safe"))


@query()
def sanitize_exact(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", sanitize("text").alias("safe"))


@query(f"WITH {_FILES} SELECT path, sha256(content) AS digest FROM files")
def content_digest(spark, sf):
    return fingerprint.content_digests(documents(spark, sf).files)


@query(f"WITH {_FILES} SELECT sha256(string_agg(path || chr(0) || strlen(content) || chr(10), '' ORDER BY path)) AS digest, count(*) AS n FROM files")
def quick_fingerprint(spark, sf):
    line = F.concat(F.col("path"), F.lit("\0"), F.octet_length("content").cast("string"), F.lit("\n"))
    return fingerprint.fold(documents(spark, sf).files.select("path", line.alias("l")), F.col("l"), "path")


@query("""WITH a AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents), b AS (SELECT page_id::VARCHAR AS path, sha256(html) AS digest FROM pages)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'missing' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def manifest_digest_check(spark, sf):
    a = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"))
    b = _table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("digest"))
    return fingerprint.differences(a, b)


@query(rf"WITH {_CHATS}, {_LINES} SELECT path, line, regexp_extract(text, '^([A-Za-z0-9_-]+)[:.]', 1) AS job FROM lines WHERE regexp_matches(text, '^[A-Za-z0-9_-]+[:.]') AND regexp_extract(text, '^([A-Za-z0-9_-]+)[:.]', 1) NOT IN ('stages', 'include', 'variables', 'default', 'workflow')")
def yaml_like_jobs(spark, sf):
    job = F.regexp_extract("text", "^([A-Za-z0-9_-]+)[:.]", 1)
    return chats(spark, sf).lines.select("path", "line", job.alias("job")).where((F.col("job") != "") & ~F.col("job").isin("stages", "include", "variables", "default", "workflow"))


_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]])', '\\\1', 'g'), '(?m)^(\s*)([#+-])', '\1\\\2', 'g'), '(?m)^(\s*[0-9]+)([.)])', '\1\\\2', 'g')"""


@query(f"SELECT doc_id, {_ESCAPED} AS escaped FROM documents")
def markdown_escaped(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", markdown_escape(F.col("text")).alias("escaped"))
