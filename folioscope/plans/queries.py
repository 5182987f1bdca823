"""Queries over plain tables, one per operator, and DuckDB SQL for the same rows.

Texts of the tables hold no procedures, so lexicons and patterns are given as
parameters that occur in them, or documents are composed from other tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..lineage import dealt, spread
from ..operators import citations as K
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import rewriting as R
from ..operators import similarity as V
from ..operators import structure as S
from ..operators import training as TR
from ..sources import corpus as C

TERMS = ("the", "of", "and", "to", "in")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_table(read(spark, sf_dir, "documents"))


_D = "d as (select doc_id::varchar as sop_id, coalesce(text, '') as body, lang, source from documents)"
_W = f"regexp_extract_all(body, '{L.WORD_PATTERN.replace(chr(39), chr(39) * 2)}')"

# --- text --------------------------------------------------------------------------


@query(f"""with {_D}, w as (select sop_id, {_W} as w from d)
  select sop_id, len(w)::int as n_words, len(list_distinct(list_transform(w, lambda x: lower(x))))::int as n_distinct from w""")
def t1_words(spark, sf_dir):
    w = T.words(F.col("body"))
    return documents(spark, sf_dir).select("sop_id", w.alias("w")).select("sop_id", F.size("w").alias("n_words"), F.size(F.array_distinct(F.transform("w", F.lower))).alias("n_distinct"))


_ABBREVIATED = ", ".join(f"'{a}'" for a in L.ABBREVIATIONS)
_PIECES = r"""p as (select sop_id, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+(["''(A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> '') as p from d),
  u as (select sop_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as piece, p from p),
  s as (select sop_id, i, piece, i = 1 or lower(regexp_extract(p[i - 1], '(\S+)$', 1)) not in (""" + _ABBREVIATED + r""") as starts from u)"""


@query(f"""with {_D}, {_PIECES},
  j as (select sop_id, string_agg(case when i = 1 then '' when starts then '|' else ' ' end || piece, '' order by i) as t, count(*) filter (starts) as n from s group by 1)
  select d.sop_id, coalesce(n, 0)::int as n_sentences, md5(coalesce(t, '')) as digest from d left join j using (sop_id)""")
def t2_sentences(spark, sf_dir):
    rows = documents(spark, sf_dir).select("sop_id", T.sentences(F.col("body")).alias("s"))
    return rows.select("sop_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


#: Lines of one or two words stand in for headings.
_SHORT_LINE = r"^\S+( \S+)?$"


@query(rf"""with {_D}, l as (select sop_id, unnest(range(0, len(a))) as pos, unnest(a) as line from (select sop_id, regexp_split_to_array(body, '\r\n|[\n\r\x0B\x0C]') as a from d)),
  h as (select *, regexp_matches(line, '{_SHORT_LINE}') as head from l),
  g as (select *, count(*) filter (head) over (partition by sop_id order by pos) as section from h),
  s as (select sop_id, section, coalesce(max(line) filter (head), 'Preamble') as heading, trim(coalesce(string_agg(line, chr(10) order by pos) filter (not head), ''), ' ' || chr(10) || chr(9)) as body from g group by 1, 2)
  select sop_id, (row_number() over (partition by sop_id order by section) - 1)::int as index, heading, length(body)::int as n_chars from s where section > 0 or body <> ''""")
def t3_sections(spark, sf_dir):
    short = lambda line: F.when(line.rlike(_SHORT_LINE), line)
    return S.sections(documents(spark, sf_dir), short).select("sop_id", "index", "heading", F.length("body").alias("n_chars"))


def order_documents(spark, sf_dir, where: str = "true") -> DataFrame:
    """Procedures composed of orders' lines: headings, steps in three styles."""
    items = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey")
    items.createOrReplaceTempView("order_items")
    return spark.sql(
        rf"""select cast(l_orderkey as string) as sop_id, concat('## 1. Purpose\nOrder ', cast(l_orderkey as string), '.\nII. Procedure\n',
          array_join(transform(sort_array(collect_list(struct(l_linenumber, case l_linenumber % 3
            when 0 then concat(cast(l_linenumber as string), '. Record part ', cast(l_partkey as string), '.')
            when 1 then concat('Step ', cast(l_linenumber as string), ': item must be shipped by ', cast(l_suppkey as string))
            else concat('- verify it shall be packed ', l_returnflag) end as line))), x -> x.line), '\n'), '\nREVISION HISTORY\nnone') as body
          from order_items where {where} group by l_orderkey"""
    ).selectExpr("sop_id", "body", "concat('Order ', sop_id) as title", "body as full_text", "'ORD' as department")


_ORDERS = r"""o as (select l_orderkey::varchar as sop_id, l_linenumber as k, l_partkey, l_suppkey, l_returnflag from lineitem)"""


@query(f"""with {_ORDERS} select sop_id, count(*)::bigint as n_steps,
  md5(string_agg(case when k % 3 = 0 then 'Record part ' || l_partkey || '.' else 'item must be shipped by ' || l_suppkey end, '|' order by k, case when k % 3 = 0 then l_partkey else l_suppkey end::varchar || '.')) as digest
  from o where k % 3 <> 2 group by 1""")
def t6_step_lines(spark, sf_dir):
    rows = S.step_lines(order_documents(spark, sf_dir))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|")
    return rows.groupBy("sop_id").agg(F.count("*").alias("n_steps"), F.md5(joined).alias("digest"))


@query(f"""with {_ORDERS} select sop_id, 'markdown' as style, 1::bigint as n from (select distinct sop_id from o)
  union all select sop_id, 'roman', 1 from (select distinct sop_id from o) union all select sop_id, 'allcaps', 1 from (select distinct sop_id from o)
  union all select sop_id, 'stepcolon', count(*) from o where k % 3 = 1 group by 1""")
def t5_headings(spark, sf_dir):
    return S.headings(order_documents(spark, sf_dir)).groupBy("sop_id", "style").agg(F.count("*").alias("n"))


@query(f"""with {_ORDERS} select sop_id, count(*)::bigint as n_steps, count(*) filter (k % 3 <> 1)::bigint as n_verb_first from o group by 1""")
def t7_marked_steps(spark, sf_dir):
    rows = S.marked_steps(order_documents(spark, sf_dir))
    return rows.groupBy("sop_id").agg(F.count("*").alias("n_steps"), F.sum(T.starts_with_verb(F.col("text")).cast("long")).alias("n_verb_first"))


@query(f"""with {_ORDERS} select distinct sop_id, true as purpose, false as scope, true as procedure, true as "revision history" from o""")
def p6_sections_present(spark, sf_dir):
    return S.sections_present(order_documents(spark, sf_dir)).select("sop_id", "purpose", "scope", "procedure", "revision history")


@query(f"""with {_ORDERS} select sop_id, (count(*) filter (k % 3 = 1))::int as must, (count(*) filter (k % 3 = 2))::int as shall,
  (count(*) filter (k % 3 <> 0))::int as n_passive from o group by 1""")
def f5_modal_counts(spark, sf_dir):
    rows = order_documents(spark, sf_dir).select("sop_id", T.modal_counts(F.col("body")).alias("m"), T.count_passive(F.col("body")).alias("n_passive"))
    return rows.select("sop_id", "m.must", "m.shall", "n_passive")


_EDGE = r"[^\p{L}\p{N}_-]"


@query(rf"""with {_D} select sop_id, len(regexp_extract_all(' ' || regexp_replace(body, '({_EDGE})', '\1\1', 'g') || ' ', '(?i){_EDGE}({"|".join(TERMS)}){_EDGE}'))::int as n_terms from d""")
def f1_vague_terms(spark, sf_dir):
    return documents(spark, sf_dir).select("sop_id", F.size(T.ambiguous_terms(F.col("body"), TERMS)).alias("n_terms"))


@query(f"""with {_D} select sop_id, len(list_filter(regexp_extract_all(lower(body), '[a-z]{{6,}}'), lambda w: regexp_matches(w, '(tion|sion|ment|ance|ence|ility)$')))::int as n_nominal from d""")
def f4_nominalizations(spark, sf_dir):
    return documents(spark, sf_dir).select("sop_id", T.count_nominalizations(F.col("body")).alias("n_nominal"))


@query(f"""with {_D}, {_PIECES}, n as (select sop_id, count(*) filter (starts) as n from s group by 1),
  w as (select sop_id, {_W} as w, len(regexp_extract_all(body || ' ', '[.!?]\\s')) as marks from d where lang = 'en'),
  y as (select sop_id, w, marks, list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - case when len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 and lower(x) like '%e' then 1 else 0 end)) as y from w),
  c as (select sop_id, len(w) as w, greatest(coalesce(n.n, 0), marks, 1) as s, coalesce(list_sum(y), 0) as y, len(list_filter(y, lambda x: x >= 3)) as c,
          coalesce(list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')))), 0) as l from y left join n using (sop_id)),
  g as (select *, case when w > 0 then 0.39e0 * w / s + 11.8e0 * y / w - 15.59e0 else 0 end as fk, case when w > 0 then 0.4e0 * (w::double / s + 100.0e0 * c / w) else 0 end as fog,
          case when w > 0 then 5.88e0 * l / w - 29.6e0 * s / w - 15.8e0 else 0 end as cl from c)
  select sop_id, w::int as n_words, s::int as n_sentences, y::int as n_syllables, round(fk, 6)::double as flesch_kincaid, round(fog, 6)::double as gunning_fog, round(cl, 6)::double as coleman_liau,
    case when w < 40 then 'n/a' when (fk + fog + cl) / 3 <= 12 then 'pass' when (fk + fog + cl) / 3 <= 16 then 'warn' else 'fail' end as status from g""".replace("\\\\", "\\"))
def m03_readability(spark, sf_dir):
    rows = Q.readability(C.english(documents(spark, sf_dir)))
    return rows.select("sop_id", "n_words", "n_sentences", "n_syllables", *[F.round(c, 6).alias(c) for c in ("flesch_kincaid", "gunning_fog", "coleman_liau")], "status")


@query("""select o_orderkey as id, o_orderdate::date < date '1996-01-01' as overdue from orders""")
def f12_overdue(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.overdue(F.date_format("o_orderdate", "yyyy-MM-dd"), "1996-01-01").alias("overdue"))


@query("""select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as iso from orders""")
def f26_parse_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    written = (
        F.when(k == 0, F.date_format(d, "d MMMM yyyy"))
        .when(k == 1, F.date_format(d, "MMM d, yyyy"))
        .when(k == 2, F.date_format(d, "d/M/yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.parse_date(written)["iso"].alias("iso"))


@query("""with v as (select l_orderkey as id, l_linenumber as line, unnest([l_quantity, l_tax * 100]) as value, unnest(['ml', '%']) as unit from lineitem)
  select id, line, unit, round(value, 3) as value from v""")
def f13_values_with_units(spark, sf_dir):
    text = F.concat(F.lit("add "), F.format_string("%d", F.col("l_quantity").cast("int")), F.lit(" mL at "), F.replace(F.round(F.col("l_tax") * 100, 3).cast("string"), F.lit("."), F.lit(",")), F.lit("%"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.explode(T.values_with_units(text)).alias("v"))
    return rows.select("id", "line", "v.unit", "v.value")


@query(f"""with {_D}, w as (select sop_id, list_transform({_W}, lambda x: lower(x))[1:800] as w from d),
  n as (select sop_id, len(list_filter(w, lambda x: x in ({", ".join(f"'{m}'" for m in L.LANGUAGE_MARKS["en"])}))) as en, len(list_filter(w, lambda x: x in ({", ".join(f"'{m}'" for m in L.LANGUAGE_MARKS["es"])}))) as es from w)
  select sop_id, case when es >= 8 and es > 1.5 * en then 'es' when en >= 8 then 'en' else '' end as language from n""")
def f27_sniff_language(spark, sf_dir):
    return documents(spark, sf_dir).select("sop_id", T.sniff_language(F.col("body")).alias("language"))


# --- similarity ----------------------------------------------------------------------

_SH = f"""w as (select sop_id, list_transform({_W}, lambda x: lower(x)) as w from d),
  h as (select distinct sop_id, array_to_string(w[i:i + 4], ' ') as g from (select sop_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
  n as (select sop_id, count(*) as n from h group by 1),
  j as (select a.sop_id as a, b.sop_id as b, count(*)::double as k from h a join h b on a.g = b.g and a.sop_id < b.sop_id group by 1, 2),
  jp as (select a, b, k / (x.n + y.n - k) as jaccard from j join n x on a = x.sop_id join n y on b = y.sop_id where k / (x.n + y.n - k) >= 0.5)"""


@query(f"with {_D}, {_SH} select a, b, round(jaccard, 9) as jaccard from jp")
def v8_jaccard_pairs(spark, sf_dir):
    return V.jaccard_pairs(V.shingle_sets(documents(spark, sf_dir)), 0.5).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query(f"""with recursive {_D}, {_SH}, e as (select a, b from jp union all select b, a from jp),
  r(x, c) as (select distinct a, a from e union select e.b, r.c from r join e on e.a = r.x)
  select c as cluster, count(*)::int as size from (select x, min(c) as c from r group by 1) group by 1""")
def g7_clusters(spark, sf_dir):
    pairs = V.jaccard_links(V.shingle_sets(documents(spark, sf_dir)), 0.5)
    return G.clusters(pairs, "jaccard").select("cluster", "size")


@query()
def m08_sketch_pairs(spark, sf_dir):
    """Estimated pairs; a sketch has no SQL counterpart."""
    pairs = V.sketch_pairs(V.min_hashes(V.shingle_sets(documents(spark, sf_dir))))
    return pairs.filter("estimate >= 0.5")


_TFIDF = rf"""t as (select sop_id, regexp_extract_all(lower(body), '[a-z]{{3,}}') as t from d where lang = 'en'),
  g as (select sop_id, unnest(list_concat(t, list_transform(range(1, greatest(1, len(t))), lambda i: t[i] || ' ' || t[i + 1]))) as term from t),
  tf as (select sop_id, term, count(*) as tf from g group by 1, 2), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from t),
  raw as (select sop_id, term, (ln(tf) + 1) * (ln((n + 1.0) / (df + 1)) + 1) as raw from tf join df using (term), n where df >= 2 and df <= 0.6 * n),
  v as (select sop_id, term, raw / sqrt(sum(raw * raw) over (partition by sop_id)) as weight from raw)"""


def _vectors(spark, sf_dir) -> DataFrame:
    docs = C.english(documents(spark, sf_dir))
    return V.tf_idf(docs, token="[a-z]{3,}", stop_words=(), min_df=2, max_df=0.6, sublinear=True)


@query(f"with {_D}, {_TFIDF} select sop_id, count(*)::bigint as n_terms, round(sum(weight), 6) as total, round(max(weight), 6) as largest from v group by 1")
def v2_tf_idf(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("sop_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


@query(f"""with {_D}, {_TFIDF} select a.sop_id as a, b.sop_id as b, round(sum(a.weight * b.weight), 6) as cosine from v a join v b on a.term = b.term and a.sop_id < b.sop_id
  group by 1, 2 having sum(a.weight * b.weight) >= 0.5""")
def v3_cosine_pairs(spark, sf_dir):
    return V.cosine_pairs(_vectors(spark, sf_dir), 0.5).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query()
def m02_topics(spark, sf_dir):
    """Clusters of documents: k-means on leading singular directions."""
    return V.k_means(V.svd(_vectors(spark, sf_dir)))


# --- graph ---------------------------------------------------------------------------

_NATION_EDGES = """e as (select distinct 'SOP-NAT-' || lpad(n_nationkey::varchar, 3, '0') as src, 'SOP-NAT-' || lpad(unnest([(n_nationkey * 7 + 3) % 30, (n_nationkey * n_nationkey + 1) % 25, n_regionkey])::varchar, 3, '0') as dst from nation),
  f as (select src, dst, dst <= 'SOP-NAT-024' as dst_known from e where src <> dst)"""


def nation_documents(spark, sf_dir) -> DataFrame:
    """Nations as documents that refer to each other, and to some that don't exist."""
    name = lambda k: F.concat(F.lit("SOP-NAT-"), F.lpad(k.cast("string"), 3, "0"))
    k = F.col("n_nationkey")
    body = F.concat_ws(" and ", name((k * 7 + 3) % 30), name((k * k + 1) % 25), name(F.col("n_regionkey")))
    return read(spark, sf_dir, "nation").select(name(k).alias("sop_id"), F.concat(F.lit("See "), body, F.lit(".")).alias("body"))


def _links(spark, sf_dir) -> DataFrame:
    docs = nation_documents(spark, sf_dir)
    return G.edges(docs, docs)


@query(f"with {_NATION_EDGES} select * from f")
def g1_edges(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"with {_NATION_EDGES} select dst, array_to_string(list_sort(list(src)), ',') as citers from f where not dst_known group by 1")
def g5_broken_references(spark, sf_dir):
    return G.broken_references(_links(spark, sf_dir)).select("dst", F.array_join("citers", ",").alias("citers"))


@query(f"""with {_NATION_EDGES}, n as (select 'SOP-NAT-' || lpad(n_nationkey::varchar, 3, '0') as sop_id from nation)
  select sop_id, (select count(*) from f where dst = sop_id)::bigint as in_degree, (select count(*) from f where src = sop_id)::bigint as out_degree from n""")
def a8_degrees(spark, sf_dir):
    docs = nation_documents(spark, sf_dir)
    return G.degrees(docs, G.edges(docs, docs))


@query(f"with {_NATION_EDGES} select dst, count(*)::bigint as in_degree from f group by 1 order by 2 desc, 1 limit 5")
def g6_hubs(spark, sf_dir):
    return G.hubs(_links(spark, sf_dir))


@query(f"""with recursive {_NATION_EDGES}, p(path, first, last) as (select [src, dst], src, dst from f where dst > src
    union all select list_append(path, dst), first, dst from p join f on f.src = last where dst > first and not list_contains(path, dst))
  select array_to_string(path, ',') as nodes, len(path)::int as length from p join f on f.src = last and f.dst = first""")
def g3_cycles(spark, sf_dir):
    return G.cycles(_links(spark, sf_dir)).select(F.array_join("nodes", ",").alias("nodes"), "length")


@query(f"""with recursive {_NATION_EDGES}, r(a, b) as (select src, dst from f union select r.a, f.dst from r join f on f.src = r.b)
  select src, dst from f where exists (select 1 from r where a = dst and b = src)""")
def g4_cycle_edges(spark, sf_dir):
    return G.cycle_edges(_links(spark, sf_dir))


# --- citations, coverage, ranks --------------------------------------------------------

_REGISTER = (("EU GMP Annex 1", "2022 revision", "sterile", ("2008", "2003")), ("ISO 14644-1", "2015", "rooms", ("1999",)), ("ICH Q9(R1)", "R1 (2023)", "risk", ("2005",)))


def citation_register(spark) -> DataFrame:
    return spark.createDataFrame([(a, b, c, list(d)) for a, b, c, d in _REGISTER], "canonical string, current string, topic string, outdated array<string>")


def part_documents(spark, sf_dir) -> DataFrame:
    size = F.col("p_size") % 3
    year = F.when(size == 0, "2022").when(size == 1, "2008").otherwise("2003")
    text = F.concat(
        F.lit("Follows EU GMP Annex 1 ("), year, F.lit(" revision); rooms are tested as told by local rules and norms, see ISO 14644-1:"),
        F.when(F.col("p_partkey") % 2 == 0, "1999").otherwise("2015"), F.lit(". Risk: ICH Q9. See PDA TR-60."),
    )
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("sop_id"), text.alias("full_text"))


@query("""with p as (select p_partkey::varchar as sop_id, p_size % 3 as s, p_partkey % 2 as k from part)
  select sop_id, 'EU GMP Annex 1' as canonical, case when s = 0 then 'current' else 'outdated' end as status, '2022 revision' as current_version from p
  union all select sop_id, 'ISO 14644-1', case when k = 0 then 'outdated' else 'current' end, '2015' from p
  union all select sop_id, 'ICH Q9(R1)', 'outdated', 'R1 (2023)' from p union all select sop_id, 'PDA TR-60', 'unknown', '' from p""")
def m05_citations(spark, sf_dir):
    return K.citations(part_documents(spark, sf_dir), citation_register(spark)).select("sop_id", "canonical", "status", "current_version")


_BANDS = (("Small", "Brand#11", 1, 10), ("Large", "Brand#12", 100_000, 200_000), ("Fitting", "Brand#13", 1, 100_000), ("None", "Brand#99", 1, 5))


@query(f"""with b(topic, dept, lo, hi) as (values {", ".join(map(str, _BANDS))}), c as (select p_brand as dept, count(*) as n from part group by 1)
  select topic, dept, coalesce(n, 0)::bigint as actual, lo::int as expected_min, hi::int as expected_max,
    case when coalesce(n, 0) = 0 then 'absent' when n > hi then 'over-documented' when n < lo then 'under-documented' else 'adequate' end as status from b left join c using (dept)""")
def m09_coverage(spark, sf_dir):
    bands = spark.createDataFrame(list(_BANDS), "topic string, dept string, expected_min int, expected_max int")
    return Q.coverage(read(spark, sf_dir, "part"), bands, "p_brand")


@query(f"""with {_D}, w as (select sop_id, len({_W}) as n from d) select sop_id, n::int as n_words, (row_number() over (order by n desc, sop_id))::int as rank from w order by n desc, sop_id limit 12""")
def o2_longest(spark, sf_dir):
    return Q.ranked(documents(spark, sf_dir).select("sop_id", F.size(T.words(F.col("body"))).alias("n_words")), "n_words", most=12)


@query()
def m07_scorecard(spark, sf_dir):
    docs = order_documents(spark, sf_dir).withColumn("next_review", F.lit("2025-01-01"))
    found = K.citations(docs.withColumn("body", F.concat("body", F.lit("\nPer ISO 14644-1:2015 and ICH Q9."))), citation_register(spark), text="body")
    return Q.scorecard(docs, docs, found).select("sop_id", *[F.round(d, 6).alias(d) for d in Q.DIMENSIONS], F.round("overall", 6).alias("overall"), "status")


@query()
def m06_rewrites(spark, sf_dir):
    rows = R.rewrites(C.english(documents(spark, sf_dir)))
    return rows.select("sop_id", F.col("before.grade").alias("before_grade"), F.col("after.grade").alias("after_grade"), "after.flagged", "after.passive", "status")


@query()
def m13_training(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    cited = K.citations(docs.withColumn("full_text", F.concat("full_text", F.lit("\nPer ISO 14644-1:2015 and ICH Q9."))), citation_register(spark))
    return TR.packages(docs, cited).select("sop_id", F.size("steps").alias("n_steps"), "method", F.size("quiz").alias("n_questions"), "aids", "est_minutes", "status")
