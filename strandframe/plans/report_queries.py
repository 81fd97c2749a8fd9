"""Queries of evaluation, report and scalar operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar, naming, sequence
from strandframe.operators import evaluation as V
from strandframe.operators import kmers as K
from strandframe.plans.catalogue import AL, AQ, CM, DNA, OV, _alignments, _bins, _contacts, _parts, _sequences, _t, query
from strandframe.sources import writers

TRUTH = """tr AS (SELECT l_partkey AS name, l_returnflag AS f, CAST(l_quantity AS INT) AS q, l_linenumber AS i, l_partkey % 7 AS d, l_suppkey % 40 AS x, l_suppkey AS ref, l_orderkey * 1000000 + l_suppkey AS pos, l_linenumber % 5 = 0 AS supp FROM lineitem),
sm AS (SELECT name, f, sum(q) AS m, sum(x) AS x, sum(least(i, 20)) AS i, sum(least(d, 20)) AS d, arg_max(ref, pos) FILTER (NOT supp) AS ref FROM tr GROUP BY name, f),
idn AS (SELECT *, m / (m + x + i + d + 1e-12) AS idt FROM sm),
asg AS (SELECT p_partkey AS name, CASE WHEN coalesce(pa.idt, 0) = 0 OR coalesce(ma.idt, 0) = 0 THEN 2 WHEN ma.idt > pa.idt THEN 1 ELSE 0 END AS phase, coalesce(pa.idt, 0) AS pat, coalesce(ma.idt, 0) AS mat, pa.ref AS pat_ref, ma.ref AS mat_ref FROM part LEFT JOIN idn pa ON pa.name = p_partkey AND pa.f = 'A' LEFT JOIN idn ma ON ma.name = p_partkey AND ma.f = 'N'),
ist AS (SELECT name, phase AS truth, CAST(name % 2 AS INT) AS inferred, CASE WHEN phase = name % 2 THEN pat_ref ELSE mat_ref END AS reference FROM asg WHERE phase < 2 AND name % 3 <> 0)"""


def _cigar(kinds: str) -> F.Column:
    """Matches, inserts, deletes and mismatches from a line's numbers."""
    parts = (F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_partkey") % 7, F.col("l_suppkey") % 40)
    return F.concat(*[x for n, k in zip(parts, kinds, strict=True) for x in (n.cast("string"), F.lit(k))])


def _truth(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    rows = li.select(F.col("l_partkey").alias("query_name"), F.when(F.col("l_linenumber") % 5 == 0, 2048).otherwise(0).alias("flag"), F.col("l_suppkey").alias("ref_name"), F.col("l_quantity").cast("int").alias("mapq"), _cigar("=IDX").alias("cigar"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey")).alias("position"))
    return V.cigar_summaries(rows)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    return V.assigned_phases(names, _truth(spark, sf_dir, "A"), _truth(spark, sf_dir, "N"))


@query(f"WITH {TRUTH} SELECT name, CAST(m AS BIGINT) AS matches, CAST(x AS BIGINT) AS mismatches, CAST(i AS BIGINT) AS inserts, CAST(d AS BIGINT) AS deletes, ref AS reference, round(idt, 9) AS identity FROM idn WHERE f = 'A'")
def cigar_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, "A").withColumn("identity", F.round("identity", 9))


@query(f"WITH {TRUTH} SELECT name, phase, round(pat, 9) AS pat_identity, round(mat, 9) AS mat_identity, pat_ref, mat_ref FROM asg")
def truth_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).withColumns({"pat_identity": F.round("pat_identity", 9), "mat_identity": F.round("mat_identity", 9)})


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    inferred = _t(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 2).cast("int").alias("side"))
    return V.intersections(_assigned(spark, sf_dir), inferred)


@query(f"WITH {TRUTH} SELECT name AS \"Name\", truth || '' || inferred AS \"Set\", reference AS \"RefName\", CASE truth || '' || inferred WHEN '00' THEN 'Cornflower Blue' WHEN '11' THEN 'Tomato' WHEN '01' THEN 'Plum' ELSE 'Dark Orange' END AS \"Color\" FROM ist")
def phase_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.intersection_rows(_sets(spark, sf_dir))


@query(f"WITH {TRUTH}, g AS (SELECT reference, CAST(sum(CASE WHEN truth = inferred THEN p_size ELSE 0 END) AS BIGINT) AS cis, CAST(sum(CASE WHEN truth <> inferred THEN p_size ELSE 0 END) AS BIGINT) AS trans FROM ist JOIN part ON p_partkey = name GROUP BY 1) SELECT *, round(least(cis, trans) / CAST(nullif(greatest(cis, trans), 0) AS DOUBLE), 9) AS hamming FROM g")
def hamming_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("length"))
    return V.hamming_by_reference(_sets(spark, sf_dir), lengths).withColumn("hamming", F.round("hamming", 9))


@query("""WITH r AS (SELECT l_partkey AS q, l_returnflag AS f, CASE WHEN l_linenumber < 4 THEN l_linenumber ELSE 0 END + CASE WHEN l_partkey % 7 < 4 THEN l_partkey % 7 ELSE 0 END + l_suppkey % 40 AS bad, CAST(l_quantity AS INT) AS len FROM lineitem), g AS (SELECT q, f, sum(bad) AS bad, sum(len) AS len FROM r GROUP BY q, f)
SELECT coalesce(p.q, m.q) AS query, CAST(p.bad AS BIGINT) AS pat_nonmatch, CAST(m.bad AS BIGINT) AS mat_nonmatch, round(log2((m.bad + 1e-12) / (p.bad + 1e-12)), 6) AS score, CASE WHEN p.q IS NULL THEN 'mat' WHEN m.q IS NULL THEN 'pat' WHEN p.bad < m.bad THEN 'pat' WHEN m.bad < p.bad THEN 'mat' WHEN p.len >= m.len THEN 'pat' ELSE 'mat' END AS parent
FROM (SELECT * FROM g WHERE f = 'A') p FULL JOIN (SELECT * FROM g WHERE f = 'N') m ON p.q = m.q""")
def phase_by_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").alias("query"), F.lit(0).alias("qstart"), F.col("l_quantity").cast("int").alias("qstop"), _cigar("=IDX").alias("cigar"))
    side = lambda f: li.where(F.col("l_returnflag") == f)
    return V.phase_by_alignment(side("A"), side("N"), 4).withColumn("score", F.round("score", 6))


@query(f"WITH {AL}, r AS (SELECT read, count(*) AS n FROM al GROUP BY read) SELECT n AS n_alignments, count(*) AS n_reads, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY n")
def read_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read_report(_alignments(spark, sf_dir))


HASHED = f"""{OV}, mt AS (SELECT (name // 2) || '.' || (name % 2) AS name, (other_name // 2) || '.' || (other_name % 2) AS other_name, score FROM sh), ln AS (SELECT (doc_id // 2) || '.' || (doc_id % 2) AS name, (doc_id // 2) || '.' || (1 - doc_id % 2) AS mate, n_chars AS length FROM documents),
bt AS (SELECT name, max(score) AS top, sum(score) AS total FROM mt GROUP BY name), bo AS (SELECT name, max(other_name) AS other FROM mt JOIN bt USING (name) WHERE score = top GROUP BY name),
cf AS (SELECT CASE WHEN coalesce(top > 0.3 * total, false) AND length > 300 AND other = mate THEN 'true_positive' WHEN coalesce(top > 0.3 * total, false) AND length > 300 THEN 'false_positive' ELSE 'false_negative' END AS outcome, length FROM ln LEFT JOIN bt USING (name) LEFT JOIN bo USING (name))"""


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = K.shared_bins(_bins(spark, sf_dir)).where("total_hashes >= 20")
    named = lambda c: F.concat_ws(".", F.expr(f"{c} div 2").cast("string"), (F.col(c) % 2).cast("string"))
    lengths = _t(spark, sf_dir, "documents").select(named("doc_id").alias("name"), F.col("n_chars").alias("length"))
    return V.hash_confusion(shared.select(named("name").alias("name"), named("other_name").alias("other_name"), "score"), lengths, 0.3, 300)


@query(f"WITH {HASHED} SELECT outcome, count(*) AS names, CAST(sum(length) AS BIGINT) AS letters FROM cf GROUP BY outcome")
def hash_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query(f"WITH {HASHED}, n AS (SELECT sum((outcome = 'true_positive')::INT) AS tp, sum((outcome = 'false_positive')::INT) AS fp, sum((outcome = 'false_negative')::INT) AS fn FROM cf) SELECT round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS recall FROM n")
def hash_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.precision_recall(_confusion(spark, sf_dir)).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("SELECT p_brand AS metric, CAST(sum(p_size) AS BIGINT) AS reference, count(*) AS sample, round(count(*) / CAST(sum(p_size) AS DOUBLE), 9) AS share FROM part GROUP BY p_brand")
def report_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.sum("p_size").alias("reference"), F.count("*").alias("sample"))
    return V.proportions(rows).withColumn("share", F.round("share", 9))


@query("SELECT event_type AS chrom, CAST(floor(floor(epoch(ts)) / 86400) * 86400 AS BIGINT) AS bin_start, count(*) AS n FROM events GROUP BY 1, 2")
def position_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.density(_t(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), F.unix_timestamp("ts").alias("pos")), 86400)


@query("WITH h AS (SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS bin_start, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS letters FROM documents GROUP BY 1) SELECT *, CAST(sum(letters) OVER (ORDER BY bin_start DESC) AS BIGINT) AS remaining FROM h")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.weighted_lengths(_t(spark, sf_dir, "documents").select(F.col("n_chars").alias("length")), 500)


@query("WITH h AS (SELECT CAST(l_quantity AS INT) AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS n, round(sum(n) OVER (ORDER BY value) / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM h")
def observed_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observed_cdf(_t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), "q").withColumn("share", F.round("share", 9))


@query("WITH g AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey <= 20), p AS (SELECT k, factorial(20) / (factorial(CAST(k AS INT)) * factorial(CAST(20 - k AS INT))) / pow(2, 20) AS p FROM g) SELECT k, round(p, 9) AS p, round(sum(p) OVER (ORDER BY k), 9) AS cdf FROM p")
def binomial_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _t(spark, sf_dir, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("k"))
    return V.binomial_cdf(20, grid).select("k", F.round("p", 9).alias("p"), F.round("cdf", 9).alias("cdf"))


@query("WITH r AS (SELECT least(o_custkey % 97, o_custkey % 89) AS a, greatest(o_custkey % 97, o_custkey % 89) AS b, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey FROM orders), g AS (SELECT a, b, arg_max(n, o_orderkey) AS n FROM r GROUP BY a, b) SELECT a, b, n, round(greatest(1, log10(n / 10)), 9) AS weight FROM g")
def alignment_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("name_a"), (F.col("o_custkey") % 89).alias("name_b"), F.floor("o_totalprice").alias("total_matches"), F.col("o_orderkey").alias("position"))
    return V.alignment_weights(o).withColumn("weight", F.round("weight", 9))


@query("""SELECT l_linestatus AS chromosome, 'lines' AS metric, CAST(sum((l_returnflag = 'A')::INT) AS BIGINT) AS "A", CAST(sum((l_returnflag = 'N')::INT) AS BIGINT) AS "N", CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS "R" FROM lineitem GROUP BY 1""")
def report_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("chromosome")).agg(F.count("*").alias("value"))
    return V.pivoted(n.withColumn("metric", F.lit("lines")), ["A", "N", "R"]).fillna(0, ["A", "N", "R"])


@query("""WITH iv AS (SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 86400 AS e FROM events), c AS (SELECT DISTINCT user_id, unnest([s, e]) AS start FROM iv), p AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS stop FROM c)
SELECT p.user_id, start, stop, string_agg(id, ' ' ORDER BY id) AS ids FROM p JOIN iv ON iv.user_id = p.user_id AND s <= start AND e >= stop WHERE stop IS NOT NULL GROUP BY 1, 2, 3""")
def interval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + 86400).alias("stop"))
    return V.interval_map(iv, "user_id").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), " "))


@query("SELECT CAST(s_suppkey AS VARCHAR) || '_hap_a' AS name, s_name AS sequence FROM supplier UNION ALL SELECT CAST(p_partkey AS VARCHAR) || '_hap_b', p_name FROM part")
def merged_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merged_fasta(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("sequence")), _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("sequence")))


@query("SELECT p_partkey AS name, coalesce(s_name, p_name) AS sequence, '>' || p_partkey || chr(10) || coalesce(s_name, p_name) AS fasta, substr(coalesce(s_name, p_name), 1, 5) AS trimmed FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def filled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.filled(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("sequence")), _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("sequence")))
    return s.select("name", "sequence", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("fasta"), sequence.trimmed(F.col("sequence"), 5).alias("trimmed"))


@query("""SELECT l_orderkey AS query_name, l_linenumber % 2 = 0 AS turned, e.k AS op, CAST(e.n AS INT) AS len, CAST(1000 + e.r AS BIGINT) AS ref_at, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 500 - e.q ELSE 100 + e.q END AS BIGINT) AS query_at, count(*) AS n FROM
(SELECT l_orderkey, l_linenumber, unnest([{'k': 'I', 'n': l_linenumber, 'r': q, 'q': q}, {'k': 'D', 'n': l_partkey % 7, 'r': q, 'q': q + l_linenumber}, {'k': 'X', 'n': l_suppkey % 40, 'r': q + l_partkey % 7, 'q': q + l_linenumber}]) AS e FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)) WHERE e.n >= 5 GROUP BY ALL""")
def oriented_cigar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_name"), (F.col("l_linenumber") % 2 == 0).alias("turned"), cigar.parse(_cigar("=IDX")).alias("ops"))
    n = lambda x: F.lit(x).cast("long")
    e = li.select("query_name", "turned", F.explode(cigar.oriented_events(F.col("ops"), 5, F.col("turned"), n(1000), n(0), n(100), n(500))).alias("e"))
    return e.groupBy("query_name", "turned", "e.op", "e.len", "e.ref_at", "e.query_at").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, upper(printf('#%02X%02X%02X', CAST(round(255 * CASE WHEN t < 0.5 THEN 0.23 + (0.87 - 0.23) * (t * 2) ELSE 0.87 + (0.71 - 0.87) * (t * 2 - 1) END) AS INT), CAST(round(255 * CASE WHEN t < 0.5 THEN 0.30 + (0.87 - 0.30) * (t * 2) ELSE 0.87 + (0.02 - 0.87) * (t * 2 - 1) END) AS INT), CAST(round(255 * CASE WHEN t < 0.5 THEN 0.75 + (0.87 - 0.75) * (t * 2) ELSE 0.87 + (0.15 - 0.87) * (t * 2 - 1) END) AS INT))) AS colour, round(t, 9) AS share FROM (SELECT c_custkey, (least(greatest(c_acctbal / 5000, -1), 1) + 1) / 2 AS t FROM customer)")
def colour_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), naming.clamped(F.col("c_acctbal"), 5000).alias("t"))
    return c.select("id", naming.map_colour(F.col("t")).alias("colour"), F.round("t", 9).alias("share"))


@query("SELECT s_suppkey AS id, (s_suppkey * 64) % 4096 AS flag, ((s_suppkey * 64) % 4096) & 64 <> 0 AS first_mate, ((s_suppkey * 64) % 4096) & 128 <> 0 AS second_mate, ((s_suppkey * 64) % 4096) & 256 = 0 AS is_primary, ((s_suppkey * 64) % 4096) & 2048 <> 0 AS supplementary, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN s_suppkey % 2 = 0 THEN 100000 - s_suppkey - 10 ELSE s_suppkey END AS start, CASE WHEN s_suppkey % 2 = 0 THEN 100000 - s_suppkey ELSE s_suppkey + 10 END AS stop, round(1 - pow(10, -(s_suppkey % 60) / 10.0), 9) AS identity FROM supplier")
def alignment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 64) % 4096).alias("flag"))
    turned = F.col("id") % 2 == 0
    r = naming.forward_range(turned, F.col("id"), F.col("id") + 10, F.lit(100000).cast("long"))
    f = F.col("flag")
    return s.select("id", "flag", naming.is_first_mate(f).alias("first_mate"), naming.is_second_mate(f).alias("second_mate"), naming.is_primary(f).alias("is_primary"), naming.is_supplementary(f).alias("supplementary"), naming.strand(turned).alias("strand"), r.start.alias("start"), r.stop.alias("stop"), F.round(naming.qv_identity(F.col("id") % 60), 9).alias("identity"))


@query("SELECT name, row_number() OVER (ORDER BY CASE WHEN k = 23 THEN 1000 ELSE k END) AS place, CAST(k % 2 AS INT) AS haplotype FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 23 THEN 'chrX.1' ELSE 'chr' || n_nationkey || '.' || (n_nationkey % 2) END AS name FROM nation)")
def chromosome_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 23, "chrX.1").otherwise(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"), F.lit("."), (F.col("n_nationkey") % 2).cast("string"))).alias("name"))
    return n.select("name", F.row_number().over(Window.orderBy(naming.chromosome_order(F.col("name")))).cast("long").alias("place"), naming.haplotype_of_name(F.col("name")).alias("haplotype"))


@query(f"WITH {AL}, {AQ}, {CM} SELECT a AS name_a, b AS name_b, weight AS total_matches, 0 AS symmetrical, CASE WHEN a % 10 > b % 10 THEN 'Cornflower Blue' ELSE 'Tomato' END AS color FROM cm WHERE a <> b UNION ALL SELECT b, a, weight, 0, CASE WHEN b % 10 > a % 10 THEN 'Cornflower Blue' ELSE 'Tomato' END FROM cm WHERE a <> b")
def alignment_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contacts(spark, sf_dir).where("a <> b")
    lengths = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") % 10).alias("length"))
    return writers.alignment_rows(c, c.limit(0), lengths)


@query("SELECT s_suppkey AS \"Id\", s_name AS \"Name\", s_nationkey AS \"Coverage\", length(s_name) AS \"Length\" FROM supplier")
def node_data_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.node_rows(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("coverage"), F.length("s_name").cast("long").alias("length")))


@query(f"WITH {AL}, {AQ}, {CM} SELECT a AS name_a, b AS name_b, weight FROM cm UNION ALL SELECT b, a, weight FROM cm WHERE a <> b")
def contact_csv_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.symmetric_contact_rows(_contacts(spark, sf_dir))


@query("SELECT s_suppkey // 4 AS component, list_has_any([s_suppkey, s_suppkey + 1], [s_suppkey + 1, s_suppkey + 2]) = false AS ok, s_suppkey AS first_of, (s_suppkey + 1) || '' AS conflicting FROM supplier")
def component_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    sides = (F.array(n, n + 1), F.array(n + 5), F.array(n + 1, n + 2), F.array(n + 9))
    c = _t(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 4").alias("component"), V.compatible(*sides).alias("ok"), V.crossed(*sides).alias("x"), V.conflicts(*sides).alias("conflicts"))
    return c.select("component", "ok", F.get("x.first", F.lit(0)).alias("first_of"), F.array_join(F.transform("conflicts", lambda v: v.cast("string")), " ").alias("conflicting"))
