"""Queries over texts: normalisation, tokens, phrases, quotes, cleaning, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators import corpus, evidence
from loomspan.operators import lineage
from loomspan.plans import tables as tb
from loomspan.plans.registry import query
from loomspan.sources import pages

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def tok(x: str) -> str:
    return rf"list_filter(list_transform(string_split(replace(lower({norm(x)}), '-', ' '), ' '), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))"


def sent(x: str) -> str:
    return rf"string_split(regexp_replace({norm(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("str01_normalize_space", f"SELECT doc_id, md5({norm('text')}) AS digest, length({norm('text')}) AS n FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"), F.char_length(T.normalize_space(F.col("text"))).cast("long").alias("n"))


_SLUG = "coalesce(nullif(rtrim(substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80), '_'), ''), 'unknown')"


@query("str02_slugify", f"SELECT c_custkey, {_SLUG.format('c_name')} AS slug FROM customer UNION ALL SELECT p_partkey, {_SLUG.format('p_name')} FROM part UNION ALL SELECT page_id, {_SLUG.format('url')} FROM pages")
def _(spark, d):
    c = tb.table(spark, d, "customer").select("c_custkey", T.slugify(F.col("c_name")).alias("slug"))
    p = tb.table(spark, d, "part").select(F.col("p_partkey").alias("c_custkey"), T.slugify(F.col("p_name")).alias("slug"))
    return c.unionByName(p).unionByName(tb.table(spark, d, "pages").select(F.col("page_id").alias("c_custkey"), T.slugify(F.col("url")).alias("slug")))


@query("str03_safe_id", r"""SELECT page_id, substr(trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '_', 'g'), '_'), 1, 80) AS id, substr(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 120) AS name FROM pages""")
def _(spark, d):
    return tb.table(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("id"), T.safe_name(F.col("url")).alias("name"))


@query("str04_tokenize", f"SELECT doc_id, len({tok('text')}) AS n, md5(array_to_string({tok('text')}, ' ')) AS digest FROM documents")
def _(spark, d):
    t = T.tokenize(F.col("text"))
    return tb.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("str05_ngrams", f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents),
g AS (SELECT doc_id, list_concat(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i+1], ' ')), list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) AS g FROM t)
SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS digest FROM g""")  # fmt: skip
def _(spark, d):
    rows = tb.table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    g = rows.select("doc_id", T.ngrams(F.col("t"), 2, 3).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("str06_sentences", f"""SELECT doc_id, len({sent('text')}) AS sentences, list_filter({sent('text')}, lambda s: contains(lower(s), 'the'))[1] AS first_hit FROM documents""")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"), T.first_sentence_with(F.col("text"), F.lit("the")).alias("first_hit"))


_PARTS = f"list_filter(list_transform(string_split({norm('text')}, '.'), lambda s: trim(s)), lambda s: s <> '')"


@query("str07_leading_sentence", f"SELECT doc_id, substr(coalesce(list_filter({_PARTS}, lambda s: contains(lower(s), 'and the') OR contains(lower(s), 'que'))[1], {_PARTS}[1], ''), 1, 320) AS lead FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", T.leading_sentence(F.col("text"), ["and the", "que"]).alias("lead"))


@query("str08_phrase_boundary", """SELECT n.label AS node, count(*) AS docs FROM documents, (VALUES ('the'), ('of the'), ('que'), ('und'), ('mit license')) n(label)
WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || label || '($|[^a-z0-9])') GROUP BY 1""")  # fmt: skip
def _(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", "text")
    labels = F.explode(F.array(*(F.lit(x) for x in ("the", "of the", "que", "und", "mit license")))).alias("node")
    return docs.select("text", labels).where(T.has_phrase(F.col("text"), F.col("node"))).groupBy("node").agg(F.count("*").alias("docs"))


@query("str09_phrase_match", f"""WITH n(phrase) AS (VALUES ('of and the in license'), ('the reation hation'), ('public general version')),
t AS (SELECT doc_id, lower({norm('text')}) AS low, {tok('text')} AS t FROM documents), p AS (SELECT phrase, list_distinct({tok('phrase')}) AS own FROM n)
SELECT phrase, count(*) AS docs FROM t, p WHERE contains(low, phrase) OR (len(own) > 0 AND len(list_intersect(own, list_distinct(t))) >= 0.67 * len(own)) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    docs = tb.table(spark, d, "documents").select("text", F.explode(F.array(F.lit("of and the in license"), F.lit("the reation hation"), F.lit("public general version"))).alias("phrase"))
    return docs.where(T.phrase_match(F.col("text"), F.col("phrase"))).groupBy("phrase").agg(F.count("*").alias("docs"))


@query("str10_whole_names", rf"""WITH n AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'text', doc_id, text FROM documents),
s AS (SELECT kind, id, regexp_replace({norm('name')}, '^[ .,:;()\[\]{{}}]+|[ .,:;()\[\]{{}}]+$', '', 'g') AS b FROM n)
SELECT kind, id, CASE WHEN len(string_split(b, ' ')) > 6 OR lower(b) IN ('the', 'this', 'that', 'these', 'those', 'our', 'we') THEN '' ELSE b END AS name FROM s""")  # fmt: skip
def _(spark, d):
    whole = lambda kind, table, key, name: tb.table(spark, d, table).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), T.entity_name(F.col(name)).alias("name"))
    names = whole("part", "part", "p_partkey", "p_name").unionByName(whole("supplier", "supplier", "s_suppkey", "s_name")).unionByName(whole("customer", "customer", "c_custkey", "c_name"))
    return names.unionByName(whole("text", "documents", "doc_id", "text"))


_SING = "CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END"


@query("str13_alias_norm", f"SELECT doc_id, md5(array_to_string(list_transform({tok('text')}, lambda t: {_SING}), ' ')) AS norm FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.md5(T.alias_norm(F.col("text"))).alias("norm"))


_STEM = "CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%ing' AND length(t) > 5 THEN regexp_replace(t, 'ing$', '') WHEN t LIKE '%ed' AND length(t) > 4 THEN regexp_replace(t, 'ed$', '') WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END"


@query("str14_stem", f"SELECT doc_id, md5(array_to_string(list_transform({tok('text')}, lambda t: {_STEM}), ' ')) AS stems FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.transform(T.tokenize(F.col("text")), T.stem), " ")).alias("stems"))


LABEL = "CASE WHEN length(t) <= 3 OR regexp_matches(t, '(ss|us|is)$') THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '(ches|shes|xes|zes)$') AND length(t) > 5 THEN regexp_replace(t, 'es$', '') WHEN t LIKE '%s' AND length(t) > 4 THEN regexp_replace(t, 's$', '') ELSE t END"


@query("str15_label_singular", f"SELECT doc_id, md5(array_to_string(list_transform({tok('text')}, lambda t: {LABEL}), ' ')) AS label FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.transform(T.tokenize(F.col("text")), T.label_singular), " ")).alias("label"))


@query("str16_token_sets", f"""SELECT doc_id, len(list_distinct(list_filter({tok('text')}, lambda t: length(t) >= 4))) AS content_tokens, md5(array_to_string(list_transform({tok('text')}, lambda t: substr(t, 1, 1)), '')) AS acronym FROM document""", tb.DOCUMENTS)
def _(spark, d):
    own = F.array_distinct(F.filter(T.tokenize(F.col("text")), lambda t: F.char_length(t) >= 4))
    return tb.documents(spark, d).select("doc_id", F.size(own).cast("long").alias("content_tokens"), F.md5(T.acronym(T.tokenize(F.col("text")))).alias("acronym"))


@query("str17_jaccard", f"""WITH t AS (SELECT conv_id, turn, list_distinct({tok('text')}) AS t FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END, 6) AS jaccard
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")  # fmt: skip
def _(spark, d):
    t = tb.table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.tokenize(F.col("text"))).alias("t"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("str19_quote_verification", f"""WITH q AS (SELECT item_id, text AS quote, lower({norm('text')}) AS low, {tok('text')} AS t, list_distinct({tok('text')}) AS own FROM benchmark),
x AS (SELECT doc_id, lower({norm('text')}) AS low, list_distinct({tok('text')}) AS t FROM documents)
SELECT item_id, count(*) AS docs FROM q, x WHERE q.low <> '' AND (contains(x.low, q.low) OR (len(q.t) >= 4 AND len(list_intersect(q.own, x.t)) >= 0.8 * len(q.own))) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return evidence.quoting_documents(tb.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")), tb.table(spark, d, "documents")).groupBy("item_id").agg(F.count("*").alias("docs"))


@query("str20_clean_abstract", None)
def _(spark, d):
    c = T.clean_abstract(F.regexp_replace(F.col("html"), "<[^>]*>", " "))
    return tb.table(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", F.md5("c.text").alias("digest"), F.array_join("c.markers", ",").alias("markers"), "c.original_length", "c.cleaned_length")


@query("str21_cleaned_rows", rf"""SELECT page_id, md5(coalesce(url, '') || chr(10) || chr(10) || {norm("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS digest, length({norm("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS n FROM pages""")
def _(spark, d):
    body = T.normalize_space(F.regexp_replace("html", "<[^>]*>", " "))
    return tb.table(spark, d, "pages").select("page_id", F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("\n\n"), body)).alias("digest"), F.char_length(body).cast("long").alias("n"))


@query("str22_excerpt", """WITH p AS (SELECT doc_id, text, instr(lower(text), 'license') AS pos FROM documents)
SELECT doc_id, CASE WHEN pos > 0 THEN substr(text, greatest(pos - 260, 1), pos + 7 + 260 - greatest(pos - 260, 1)) ELSE substr(text, 1, 520) END AS excerpt FROM p""")  # fmt: skip
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", T.around(F.col("text"), F.lit("license")).alias("excerpt"))


@query("str23_cue_near", """WITH p AS (SELECT doc_id, lower(text) AS low, instr(lower(text), 'license') AS pos FROM documents)
SELECT doc_id, pos > 0 AND (contains(substr(low, greatest(pos - 160, 1), pos + 7 + 160 - greatest(pos - 160, 1)), 'released') OR contains(substr(low, greatest(pos - 160, 1), pos + 7 + 160 - greatest(pos - 160, 1)), 'version')) AS near FROM p""")  # fmt: skip
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", T.cue_near(F.col("text"), F.lit("license"), ["released", "version"]).alias("near"))


@query("str24_display_name", """WITH m AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_type, arg_max(p_name, (-abs(length(p_name) - 36), n, p_name)) AS name FROM m GROUP BY 1""")  # fmt: skip
def _(spark, d):
    m = tb.table(spark, d, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return m.groupBy("p_type").agg(F.max_by("p_name", F.struct(-F.abs(F.char_length("p_name") - 36), "n", "p_name")).alias("name"))


@query("str27_name_of_id", "SELECT partkey, replace(regexp_replace(entity_id, '^.*?__', ''), '_', ' ') AS name, split_part(entity_id, '__', 1) AS kind FROM part_entity", tb.PARTS)
def _(spark, d):
    return tb.parts(spark, d).select("partkey", T.name_of(F.col("entity_id")).alias("name"), T.type_of(F.col("entity_id")).alias("kind"))


@query("dat01_parse_date", """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00' END AS s, o_orderdate::DATE AS day FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', day)::DATE WHEN 2 THEN NULL ELSE day END AS day FROM s""")  # fmt: skip
def _(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00")))
    return tb.table(spark, d, "orders").select("o_orderkey", V.parse_date(s).alias("day"))


@query("dat02_time_delta", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, datediff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    o = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return tb.table(spark, d, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", V.time_delta(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query("dat03_slice", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN 'given' ELSE '' END, ''), slice, 'unknown') AS slice FROM document", tb.DOCUMENTS)
def _(spark, d):
    return tb.documents(spark, d).select("doc_id", V.chronology_slice(F.when(F.col("doc_id") % 5 == 0, "given").otherwise(""), F.col("published_at")).alias("slice"))


@query("dat04_decade", "SELECT (floor(year(o_orderdate) / 10) * 10)::INTEGER AS decade, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, d):
    return tb.table(spark, d, "orders").groupBy(V.decade(V.bounded_year(F.col("o_orderdate"))).alias("decade")).agg(F.count("*").alias("orders"))


@query("dat05_duration", "SELECT o_custkey, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INTEGER AS days, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate))::VARCHAR ELSE min(year(o_orderdate)) || '-' || max(year(o_orderdate)) END AS span FROM orders GROUP BY 1")
def _(spark, d):
    y = F.year("o_orderdate")
    per = tb.table(spark, d, "orders").groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.concat_ws(" ", F.min(y), F.max(y)).alias("years"))
    return per.select("o_custkey", "days", V.year_span(F.col("years")).alias("span"))


@query("mth01_numbers", "SELECT c_custkey, round(greatest(0.0, least(1.0, coalesce(c_acctbal / 10000, 0))), 6) AS share, coalesce(try_cast(split_part(c_name, '#', 2) AS DOUBLE), 0) AS number FROM customer")
def _(spark, d):
    return tb.table(spark, d, "customer").select("c_custkey", F.round(V.clamp01(F.col("c_acctbal") / 10000), 6).alias("share"), V.number(F.element_at(F.split("c_name", "#"), 2)).alias("number"))


@query("mth02_weighted", "SELECT l_returnflag, round(avg(0.5 * l_discount + 0.3 * l_tax + 0.2 * l_quantity), 6) AS score FROM lineitem GROUP BY 1")
def _(spark, d):
    return tb.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(V.weighted({0.5: F.col("l_discount"), 0.3: F.col("l_tax"), 0.2: F.col("l_quantity")})), 6).alias("score"))


@query("arr01_listify", "SELECT doc_id, len(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.size(T.listify(F.split("text", r"\."))).cast("long").alias("n"))


@query("arr02_stable_dedupe", f"SELECT doc_id, len(list_distinct({tok('text')})) AS n, {tok('text')}[1] AS first FROM documents")
def _(spark, d):
    t = F.array_distinct(T.tokenize(F.col("text")))
    return tb.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.try_element_at(t, F.lit(1)).alias("first"))


@query("jsn01_path_lookup", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), event_type) AS value FROM events")
def _(spark, d):
    v = F.parse_json("props")
    return tb.table(spark, d, "events").select("event_id", V.first_non_empty(F.try_variant_get(v, "$.missing", "string"), F.try_variant_get(v, "$.k", "string"), F.col("event_type")).alias("value"))


@query("jsn03_run_signature", """SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS signature FROM nation""")
def _(spark, d):
    return tb.table(spark, d, "nation").select("n_nationkey", V.run_signature(F.col("n_nationkey"), F.col("n_name")).alias("signature"))


@query("jsn04_first_quote", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag = 'A' THEN 'mechanism' WHEN l_tax > 0.02 THEN 'bottleneck' ELSE 'tradeoff' END AS slot FROM lineitem")
def _(spark, d):
    def slot(name):
        return F.struct(F.lit(name).alias("k"), F.lit(name).alias("v"))

    slots = F.map_from_entries(F.array_compact(F.array(F.when(F.col("l_returnflag") == "A", slot("mechanism")), F.when(F.col("l_tax") > 0.02, slot("bottleneck")), slot("tradeoff"))))
    pick = F.coalesce(*(F.try_element_at(slots, F.lit(n)) for n in ("mechanism", "bottleneck", "tradeoff")))
    return tb.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", pick.alias("slot"))


@query("src04_corpus_load", f"""SELECT coalesce(CASE WHEN {norm('text')} = '' THEN 'missing_text' WHEN role NOT IN ('core', 'support') THEN 'role_filtered' WHEN published_at > DATE '2016-06-30' THEN 'post_cutoff' END, 'loaded') AS reason, count(*) AS n FROM document GROUP BY 1""", tb.DOCUMENTS)
def _(spark, d):
    r = corpus.skip_reason(F.col("text"), F.col("role"), F.col("published_at"), ["core", "support"], "2016-06-30")
    return tb.documents(spark, d).groupBy(F.coalesce(r, F.lit("loaded")).alias("reason")).agg(F.count("*").alias("n"))


@query("fil01_stm03_cutoff", f"SELECT doc_id, slice FROM document WHERE published_at <= DATE '2016-06-30' AND role = 'core' AND {norm('text')} <> ''", tb.DOCUMENTS)
def _(spark, d):
    r = corpus.skip_reason(F.col("text"), F.col("role"), F.col("published_at"), ["core"], "2016-06-30")
    return tb.documents(spark, d).where(r.isNull()).select("doc_id", "slice")


@query("src15_inverted_index", f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    docs = tb.table(spark, d, "documents").where("text is not null")
    return corpus.text_of_index(corpus.inverted_index(docs)).select("doc_id", F.md5("text").alias("digest"))


@query("src11_paged_works", "SELECT 'W' || (page_id - page_id % 7) AS work_id, (min(page_id) // 40)::INTEGER AS page, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def _(spark, d):
    """The pages table as pages of 40 works, of which seven rows share an id; written as JSON, read through the data source."""
    rows = tb.table(spark, d, "pages").select(F.expr("cast(page_id div 40 as int)").alias("page"), "page_id", F.concat(F.lit("W"), F.col("page_id") - F.col("page_id") % 7).alias("id"), "url")
    results = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "id", "url"))), lambda x: F.struct(x["id"].alias("id"), x["url"].alias("url")))
    root = lineage.folder(spark)
    rows.groupBy("page").agg(F.to_json(F.struct(results.alias("results"))).alias("value")).write.partitionBy("page").text(root)
    return pages.read_works(spark, root).select("work_id", "page", F.get_json_object("record", "$.url").alias("url"))
