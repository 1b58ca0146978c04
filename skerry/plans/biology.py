"""Registered queries on communities, sequences, neighbour graphs, bench arithmetic and simulation, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import curves, diversity, lab, neighbours, power, sequences, simulate
from skerry.plans.statistics import _daily, rounded
from skerry.sources.tables import load, parse_fasta

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Line items of each nation's suppliers per brand and size of the part: fine enough that rare ones occur."""
    lines = load(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    s, p = load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), load(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("p_brand"))
    j = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("s_nationkey").alias("sample"), F.col("p_brand").alias("taxon")).agg(F.count("*").alias("n"))


_C = "c AS (SELECT s_nationkey AS sample, concat_ws('-', p_brand, p_size) AS taxon, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"""WITH {_C}, s AS (SELECT sample, count(*) AS observed, sum(n) AS total, sum(n * ln(n)) AS nln, sum(n * n) AS q, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2 FROM c GROUP BY 1)
  SELECT sample, observed, total, round(ln(total) - nln / total, 6) AS shannon, round(1 - q / (total * total), 6) AS simpson, round(1 / (q / (total * total)), 6) AS inverse_simpson,
  CASE WHEN observed > 1 THEN round((ln(total) - nln / total) / ln(observed), 6) END AS pielou, f1, f2, round(observed + f1 * (f1 - 1) / (2.0 * (f2 + 1)), 6) AS chao1 FROM s""")
def alpha_diversity_nation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.alpha(_counts(spark, d)))


_CLR = "x AS (SELECT s.sample, t.taxon, ln(coalesce(c.n, 0) + 0.5) AS l FROM (SELECT DISTINCT sample FROM c) s CROSS JOIN (SELECT DISTINCT taxon FROM c) t LEFT JOIN c ON c.sample = s.sample AND c.taxon = t.taxon), y AS (SELECT sample, taxon, l - avg(l) OVER (PARTITION BY sample) AS clr FROM x)"


@query(f"WITH {_C}, {_CLR} SELECT sample, taxon, round(clr, 6) AS clr FROM y")
def clr_nation_brand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.clr(_counts(spark, d)))


@query(f"WITH {_C}, {_CLR} SELECT p.sample AS a, q.sample AS b, round(sqrt(sum((p.clr - q.clr) * (p.clr - q.clr))), 6) AS distance FROM y p JOIN y q ON p.taxon = q.taxon AND p.sample < q.sample GROUP BY 1, 2")
def aitchison_nation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.beta(_counts(spark, d), "aitchison"))


_PAIRS = "z AS (SELECT sample, taxon, n / sum(n) OVER (PARTITION BY sample) AS p FROM c), k AS (SELECT sample, count(*) AS k FROM c GROUP BY 1), m AS (SELECT a.sample AS a, b.sample AS b, sum(least(a.p, b.p)) AS l, count(*) AS shared FROM z a JOIN z b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY 1, 2), o AS (SELECT i.sample AS a, j.sample AS b, i.k AS ka, j.k AS kb FROM k i JOIN k j ON i.sample < j.sample)"


@query(f"WITH {_C}, {_PAIRS} SELECT a, b, round(1 - coalesce(l, 0), 6) AS distance FROM o LEFT JOIN m USING (a, b)")
def braycurtis_nation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.beta(_counts(spark, d), "braycurtis"))


@query(f"WITH {_C}, {_PAIRS} SELECT a, b, round(1 - CAST(coalesce(shared, 0) AS DOUBLE) / (ka + kb - coalesce(shared, 0)), 6) AS distance FROM o LEFT JOIN m USING (a, b)")
def jaccard_nation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.beta(_counts(spark, d), "jaccard"))


@query(f"""WITH {_C}, {_PAIRS}, d AS (SELECT a, b, 1 - coalesce(l, 0) AS d FROM o LEFT JOIN m USING (a, b)),
  g AS (SELECT k.sample, n_regionkey AS level, row_number() OVER (ORDER BY k.sample) AS idx FROM k JOIN nation ON n_nationkey = k.sample), z0 AS (SELECT level, count(*) AS size FROM g GROUP BY 1),
  r AS (SELECT r.range AS r, sample, row_number() OVER (PARTITION BY r.range ORDER BY CASE WHEN r.range < 0 THEN lpad(CAST(idx AS VARCHAR), 12, '0') ELSE md5(concat_ws('|', '20260901', CAST(r.range AS VARCHAR), CAST(idx AS VARCHAR))) END, idx) AS slot FROM range(-1, 999) r, g),
  q AS (SELECT r.r, r.sample, g.level FROM r JOIN g ON g.idx = r.slot), w AS (SELECT x.r, sum(d.d * d.d / z0.size) AS w FROM d JOIN q x ON x.sample = d.a JOIN q y ON y.sample = d.b AND y.r = x.r AND y.level = x.level JOIN z0 ON z0.level = x.level GROUP BY 1),
  n AS (SELECT count(*) AS n, count(DISTINCT level) AS k FROM g), t AS (SELECT sum(d * d) / max(n) AS t FROM d, n), f AS (SELECT r, ((t - w) / (k - 1)) / (w / (n - k)) AS f FROM w, t, n), ob AS (SELECT f AS o FROM f WHERE r < 0)
  SELECT round(max(o), 6) AS pseudo_f, round((count(*) FILTER (r >= 0 AND f >= o - 1e-9) + 1) / 1000.0, 6) AS p_value, round(max(o / (o + CAST(n - k AS DOUBLE) / (k - 1))), 6) AS r_squared FROM f, ob, n""")
def permanova_region(spark: SparkSession, d: str) -> DataFrame:
    distances = diversity.beta(_counts(spark, d), "braycurtis")
    labels = _counts(spark, d).select("sample").distinct().join(load(spark, d, "nation"), F.col("sample") == F.col("n_nationkey")).select("sample", F.col("n_regionkey").alias("level"))
    return rounded(diversity.permanova(distances, labels))


@query()
def pcoa_nation(spark: SparkSession, d: str) -> DataFrame:
    return diversity.pcoa(diversity.beta(_counts(spark, d), "braycurtis"))


_CURVE = """x AS (SELECT CAST(sample AS VARCHAR) AS sample, CAST(n AS BIGINT) AS a, count(*) AS f FROM c GROUP BY 1, 2), t AS (SELECT sample, CAST(sum(a * f) AS BIGINT) AS total, 2 * max(a) AS most FROM x GROUP BY 1),
  dp AS (SELECT DISTINCT sample, total, most, CASE WHEN r.range = 19 THEN total ELSE CAST(floor(r.range * ((total - 1) / 19.0::DOUBLE) + 1) AS BIGINT) END AS depth FROM t, range(20) r),
  l AS (SELECT sample, depth, total, m.range AS m, sum(CASE WHEN m.range > 0 AND total - depth > m.range - 1 THEN ln((total - depth - m.range + 1) / CAST(total - m.range + 1 AS DOUBLE)) ELSE 0.0 END) OVER (PARTITION BY sample, depth ORDER BY m.range) AS s FROM dp, range(2000) m WHERE m.range <= most),
  g AS (SELECT sample, depth, m, CASE WHEN total - depth >= m THEN exp(s) ELSE 0.0 END AS q FROM l),
  one AS (SELECT x.sample, depth, a, f, g.q FROM x JOIN g ON g.sample = x.sample AND g.m = x.a),
  own AS (SELECT o.sample, o.depth, sum(f * (1 - o.q)) AS e, sum(f * o.q * (1 - o.q) + f * (f - 1) * (g.q - o.q * o.q)) AS v FROM one o JOIN g ON g.sample = o.sample AND g.depth = o.depth AND g.m = 2 * o.a GROUP BY 1, 2),
  two AS (SELECT p.sample, p.depth, sum(2 * p.f * o.f * (g.q - p.q * o.q)) AS v FROM one p JOIN one o ON o.sample = p.sample AND o.depth = p.depth AND o.a > p.a JOIN g ON g.sample = p.sample AND g.depth = p.depth AND g.m = p.a + o.a GROUP BY 1, 2),
  curve AS (SELECT sample, depth, e AS expected, sqrt(greatest(own.v + coalesce(two.v, 0), 0.0)) AS sd FROM own LEFT JOIN two USING (sample, depth))"""


@query(f"WITH {_C}, {_CURVE} SELECT sample, depth, round(expected, 6) AS expected, round(sd, 4) AS sd, round(greatest(expected - 1.959963984540054 * sd, 0.0), 4) AS low, round(expected + 1.959963984540054 * sd, 4) AS high FROM curve")
def rarefaction_nation(spark: SparkSession, d: str) -> DataFrame:
    r = rounded(diversity.rarefaction(_counts(spark, d)), "sd", "low", "high")
    return r.withColumns({c: F.round(c, 4) for c in ("sd", "low", "high")})


@query(f"""WITH {_C}, {_CURVE}, w AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY depth) AS i, count(*) OVER (PARTITION BY sample) AS m FROM curve),
  p AS (SELECT sample, max(m) AS m, max(depth) FILTER (i = 1) AS d1, max(depth) FILTER (i = 2) AS d2, max(expected) FILTER (i = 1) AS e1, max(expected) FILTER (i = 2) AS e2, max(depth) FILTER (i = m - greatest(2, m // 5) + 1) AS d3, max(depth) FILTER (i = m) AS d4, max(expected) FILTER (i = m - greatest(2, m // 5) + 1) AS e3, max(expected) FILTER (i = m) AS e4 FROM w GROUP BY 1),
  r AS (SELECT sample, (e4 - e3) / greatest(1, d4 - d3) AS end_slope, (e2 - e1) / greatest(1, d2 - d1) AS first_slope FROM p WHERE m > 1)
  SELECT sample, round(end_slope, 6) AS end_slope, round(first_slope, 6) AS first_slope, end_slope < 0.1 * greatest(first_slope, 1e-12) AS saturated FROM r""")
def saturation_nation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.saturation(diversity.rarefaction(_counts(spark, d))))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", sequences.clean(F.col("text")).alias("s"))


_S = "s AS (SELECT doc_id, regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGT]', '', 'g') AS s FROM documents)"
_N = "len(s) - len(replace(s, '{0}', ''))"


@query(f"""WITH {_S}, n AS (SELECT doc_id, len(s) AS length, {', '.join(f"{_N.format(b)} AS n_{b.lower()}" for b in 'ACGT')} FROM s)
  SELECT doc_id, length, n_a, n_c, n_g, n_t, CASE WHEN length > 0 THEN round(CAST(n_g + n_c AS DOUBLE) / length, 9) END AS gc, CASE WHEN length > 13 THEN round(64.9 + 41 * (CAST(n_g + n_c AS DOUBLE) - 16.4) / length, 6) WHEN length > 0 THEN 2.0 * (length - n_g - n_c) + 4.0 * (n_g + n_c) END AS melting FROM n""")
def gc_documents(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gc(_sequences(spark, d), "s", "doc_id").withColumn("gc", F.round("gc", 9)).withColumn("melting", F.round("melting", 6))


@query(f"WITH {_S} SELECT doc_id, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS reverse_md5 FROM s")
def reverse_complement_documents(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", F.md5(sequences.reverse_complement(F.col("s"))).alias("reverse_md5"))


@query(f"WITH {_S}, k AS (SELECT doc_id, substr(s, i, 4) AS kmer FROM (SELECT doc_id, s, unnest(range(1, len(s) - 2)) AS i FROM s WHERE len(s) >= 4)) SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY 1, 2")
def tetranucleotides_documents(spark: SparkSession, d: str) -> DataFrame:
    return sequences.kmers(_sequences(spark, d), "s", ["doc_id"])


_CODE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sequences.CODE.items())


@query(f"""WITH {_S}, c AS (SELECT substr(s, i, 3) AS codon FROM (SELECT s, unnest(range(1, len(s) - 1, 3)) AS i FROM s WHERE len(s) >= 3)), g AS (SELECT codon, count(*) AS n, CASE codon {_CODE} END AS amino_acid FROM c GROUP BY 1)
  SELECT codon, n, amino_acid, round(n * count(*) OVER (PARTITION BY amino_acid) / CAST(sum(n) OVER (PARTITION BY amino_acid) AS DOUBLE), 9) AS rscu FROM g""")
def codon_usage_documents(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequences.codon_usage(_sequences(spark, d), "s", []), digits=9)


_ORFS = f"""{_S}, f AS (SELECT doc_id, len(s) AS length, f, CASE WHEN f > 0 THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS t FROM s, (VALUES (1), (2), (3), (-1), (-2), (-3)) v(f)),
  c AS (SELECT doc_id, length, f, i, substr(t, i * 3 + abs(f), 3) AS codon FROM (SELECT *, unnest(range(0, greatest(0, (len(t) - abs(f) + 1) // 3))) AS i FROM f)),
  g AS (SELECT *, codon IN ('TAA', 'TAG', 'TGA') AS stop, coalesce(sum(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM c),
  o AS (SELECT doc_id, length, f, min(i) FILTER (codon IN ('ATG', 'GTG', 'TTG', 'ATT', 'CTG')) AS a, max(i) FILTER (stop) AS b FROM g GROUP BY doc_id, length, f, seg),
  r AS (SELECT doc_id, CAST(f AS INTEGER) AS frame, CAST(CASE WHEN f > 0 THEN a * 3 + abs(f) ELSE length - (b * 3 + abs(f) + 2) + 1 END AS BIGINT) AS first_base, CAST(CASE WHEN f > 0 THEN b * 3 + abs(f) + 2 ELSE length - (a * 3 + abs(f)) + 1 END AS BIGINT) AS last_base, CAST(b - a AS BIGINT) AS amino_acids FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND b - a >= 30)"""


@query(f"WITH {_ORFS} SELECT * FROM r")
def orfs_documents(spark: SparkSession, d: str) -> DataFrame:
    r = sequences.orfs(_sequences(spark, d), "s", "doc_id")
    return r.select("doc_id", "frame", *(F.col(c).cast("long") for c in ("first_base", "last_base", "amino_acids")))


@query(f"""WITH {_ORFS}, n AS (SELECT doc_id, greatest(0, last_base - greatest(first_base - 1, coalesce(max(last_base) OVER (PARTITION BY doc_id ORDER BY first_base, last_base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM r)
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS covered FROM n GROUP BY doc_id""")
def orf_coverage_documents(spark: SparkSession, d: str) -> DataFrame:
    return sequences.coverage(sequences.orfs(_sequences(spark, d), "s", "doc_id"), "doc_id").withColumn("covered", F.col("covered").cast("long"))


@query(f"WITH {_S} SELECT doc_id, array_to_string(list_transform(range(len(s) // 3), lambda i: CASE substr(s, CAST(i * 3 + 1 AS INTEGER), 3) {_CODE} END), '') AS protein FROM s")
def proteins_documents(spark: SparkSession, d: str) -> DataFrame:
    return sequences.translate(_sequences(spark, d), "s", 1).select("doc_id", "protein")


@query(f"""WITH {_S}, w AS (SELECT doc_id, i, substr(s, i + 1, 40) AS w FROM (SELECT doc_id, s, unnest(range(0, len(s) - 39, 10)) AS i FROM s WHERE len(s) >= 40))
  SELECT doc_id, CAST(i + 20 AS INTEGER) AS position, (40 - len(regexp_replace(w, '[GC]', '', 'g'))) / 40.0::DOUBLE AS gc FROM w""")
def gc_windows_documents(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gc_windows(_sequences(spark, d), "s", 40, "doc_id")


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS raw FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(raw) AS n, len(regexp_replace(replace(upper(raw), 'U', 'T'), '[^ACGT]', '', 'g')) AS length FROM t)
  SELECT doc_id, CAST(1 AS BIGINT) AS record, concat('doc', doc_id) AS seq_id, concat('doc', doc_id, ' x') AS description, CAST(length AS INTEGER) AS length, CAST(n - length AS INTEGER) AS non_standard FROM c""")
def fasta_documents(spark: SparkSession, d: str) -> DataFrame:
    texts = load(spark, d, "documents").select("doc_id", F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" x\n"), "text").alias("fasta"))
    return parse_fasta(texts, "doc_id", "fasta").drop("sequence")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the mean vectors of labels crossed with a residue, a graph of a few dozen nodes."""
    e = load(spark, d, "embeddings").select((F.col("label") * 4 + F.col("vec_id") % 4).cast("int").alias("node"), F.posexplode("embedding").alias("at", "x"))
    m = e.groupBy("node", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = m.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    return neighbours.cosine_pairs(v, "node", "v")


_V = """e AS (SELECT CAST(label * 4 + vec_id % 4 AS INTEGER) AS node, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings), m AS (SELECT node, pos, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2), n AS (SELECT node, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
  p AS (SELECT a.node AS i, b.node AS j, greatest(0.0, 1 - least(1.0, sum(a.x * b.x) / (max(na.n) * max(nb.n)))) AS d FROM m a JOIN m b ON a.pos = b.pos AND a.node < b.node JOIN n na ON na.node = a.node JOIN n nb ON nb.node = b.node GROUP BY 1, 2),
  w AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p), r AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM w)"""


@query(f"WITH {_V} SELECT i, j, round(d, 9) AS d FROM p")
def cosine_label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pairs(spark, d), digits=9)


@query(f"WITH {_V} SELECT least(i, j) AS i, greatest(i, j) AS j, round(min(d), 9) AS d FROM r WHERE rank <= 4 GROUP BY 1, 2")
def knn_label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.knn_edges(_pairs(spark, d), 4), digits=9)


@query(f"WITH {_V} SELECT least(i, j) AS i, greatest(i, j) AS j, round(min(d), 9) AS d FROM r WHERE rank <= 4 GROUP BY 1, 2 HAVING count(*) = 2")
def mutual_knn_label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.knn_edges(_pairs(spark, d), 4, True), digits=9)


@query(f"""WITH RECURSIVE {_V}, ed AS (SELECT DISTINCT k.range AS k, least(i, j) AS i, greatest(i, j) AS j FROM r, range(3, 9) k WHERE rank <= k.range), bi AS (SELECT k, i, j FROM ed UNION SELECT k, j, i FROM ed),
  reach(k, a, b) AS (SELECT k.range, node, node FROM n, range(3, 9) k UNION SELECT reach.k, reach.a, bi.j FROM reach JOIN bi ON bi.k = reach.k AND bi.i = reach.b),
  l AS (SELECT k, a AS node, min(b) AS label FROM reach GROUP BY 1, 2), s AS (SELECT k, count(DISTINCT label) AS components, string_agg(label, ',' ORDER BY node) AS sig FROM l GROUP BY 1),
  g AS (SELECT k, components, coalesce(sum(x) OVER (ORDER BY k), 0) AS run FROM (SELECT k, components, CASE WHEN sig <> lag(sig) OVER (ORDER BY k) THEN 1 END AS x FROM s))
  SELECT CAST(k AS INTEGER) AS k, components, CAST(run AS BIGINT) AS run, count(*) OVER (PARTITION BY run) AS run_length FROM g""")
def component_sweep_label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.component_sweep(_pairs(spark, d), 3, 8)


def _near_embeddings(spark: SparkSession, d: str, k: int) -> DataFrame:
    return neighbours.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", k)


_E = """e AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT node, x, sqrt(list_inner_product(x, x)) AS n FROM e),
  r AS (SELECT a.node AS i, b.node AS j, greatest(0.0, 1 - least(1.0, list_inner_product(a.x, b.x) / (a.n * b.n))) AS d FROM n a JOIN n b ON a.node <> b.node QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY d, b.node) <= 8),
  w AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM r)"""


@query(f"WITH {_E} SELECT i, j, round(d, 9) AS d, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= 5")
def nearest_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near_embeddings(spark, d, 5), digits=9)


@query(f"WITH {_E} SELECT least(i, j) AS i, greatest(i, j) AS j, round(min(d), 9) AS d FROM w WHERE rank <= 4 GROUP BY 1, 2")
def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.knn_graph(_near_embeddings(spark, d, 4), 4), digits=9)


@query(f"WITH {_E} SELECT least(i, j) AS i, greatest(i, j) AS j, round(min(d), 9) AS d FROM w WHERE rank <= 4 GROUP BY 1, 2 HAVING count(*) = 2")
def mutual_knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.knn_graph(_near_embeddings(spark, d, 4), 4, True), digits=9)


@query(f"""WITH RECURSIVE {_E}, ed AS (SELECT k.range AS k, least(i, j) AS i, greatest(i, j) AS j FROM w, range(2, 7) k WHERE rank <= k.range GROUP BY ALL HAVING count(*) = 2), bi AS (SELECT k, i, j FROM ed UNION SELECT k, j, i FROM ed),
  reach(k, a, b) AS (SELECT k.range, node, node FROM n, range(2, 7) k UNION SELECT reach.k, reach.a, bi.j FROM reach JOIN bi ON bi.k = reach.k AND bi.i = reach.b),
  l AS (SELECT k, a AS node, min(b) AS label FROM reach GROUP BY 1, 2), s AS (SELECT k, count(DISTINCT label) AS components, string_agg(label, ',' ORDER BY node) AS sig FROM l GROUP BY 1),
  g AS (SELECT k, components, coalesce(sum(x) OVER (ORDER BY k), 0) AS run FROM (SELECT k, components, CASE WHEN sig <> lag(sig) OVER (ORDER BY k) THEN 1 END AS x FROM s))
  SELECT CAST(k AS INTEGER) AS k, components, CAST(run AS BIGINT) AS run, count(*) OVER (PARTITION BY run) AS run_length FROM g""")
def component_sweep_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.sweep_of(_near_embeddings(spark, d, 6), 2, 6, mutual=True)


@query()
def curvature_label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.ollivier_ricci(neighbours.knn_edges(_pairs(spark, d), 4))


@query()
def bridge_edges_label_vectors(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    clades = neighbours.both_ways(pairs).select(F.col("i").alias("node")).distinct().withColumn("clade", F.col("node") % 2)
    return neighbours.bridges(pairs, clades, 3, 8)["edges"].select("i", "j", "curvature", "cross")


@query("""SELECT CAST(range AS INTEGER) AS tube, pow(10.0, range) AS dilution_factor, round(1e9 / pow(10.0, range), 6) AS nominal, round(1e9 / pow(10.0, range), 6) AS concentration, 1e9 / pow(10.0, range) * 0.1 BETWEEN 30 AND 300 AS countable FROM range(9)""")
def dilution_tubes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lab.dilution_series(spark), "dilution_factor")


@query("""WITH m AS (SELECT s_suppkey AS id, 1e6 * (s_suppkey % 7 + 1) AS phage, 1e6 * (s_nationkey + 1) AS bacteria FROM supplier)
  SELECT id, phage, bacteria, round(phage / bacteria, 6) AS moi, round(exp(-phage / bacteria), 6) AS uninfected, round(phage / bacteria * exp(-phage / bacteria), 6) AS single, round(1 - exp(-phage / bacteria) - phage / bacteria * exp(-phage / bacteria), 6) AS multiple,
  CASE WHEN phage / bacteria < 0.1 THEN 'low' WHEN phage / bacteria < 3 THEN 'medium' ELSE 'high' END AS regime FROM m""")
def moi_suppliers(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.lit(1e6) * (F.col("s_suppkey") % 7 + 1)).alias("phage"), (F.lit(1e6) * (F.col("s_nationkey") + 1)).alias("bacteria"))
    return rounded(lab.infection(m, "phage", "bacteria"))


_PLATES = "SELECT s_nationkey AS site, CAST(floor(s_acctbal / 100) + 20 AS BIGINT) AS plaques, CAST(pow(10.0, s_suppkey % 3 + 4) AS DOUBLE) AS dilution, 0.1 AS volume FROM supplier"


def _plates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_nationkey").alias("site"), (F.floor(F.col("s_acctbal") / 100) + 20).cast("long").alias("plaques"), F.pow(F.lit(10.0), F.col("s_suppkey") % 3 + 4).alias("dilution"), F.lit(0.1).alias("volume"))


@query(f"""WITH p AS ({_PLATES}), s AS (SELECT site, count(*) AS plates, CAST(sum(plaques) AS BIGINT) AS plaques, sum(CAST(volume AS DOUBLE) / dilution) AS v, sum(CAST(plaques AS DOUBLE) * plaques / (CAST(volume AS DOUBLE) / dilution)) AS q FROM p GROUP BY 1)
  SELECT site, plates, plaques, round(plaques / v, 2) AS titre, round(CASE WHEN plaques > 0 THEN q / (plaques / v) - plaques END, 4) AS chi2, plates - 1 AS df FROM s""")
def pooled_titre_sites(spark: SparkSession, d: str) -> DataFrame:
    r = lab.pooled_titre(_plates(spark, d), "plaques", "dilution", "volume", ["site"])
    return r.withColumn("titre", F.round("titre", 2)).withColumn("chi2", F.round("chi2", 4))


@query()
def titre_plates(spark: SparkSession, d: str) -> DataFrame:
    return lab.titre(_plates(spark, d).withColumn("plaques", F.abs("plaques")), "plaques", "dilution", "volume")


@query("""WITH s AS (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, CAST(k AS DOUBLE) / n AS p, 1 + 1.96 * 1.96 / n AS w FROM s)
  SELECT event_type, k, n, round((p + 1.96 * 1.96 / (2 * n)) / w - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / w, 6) AS low, round((p + 1.96 * 1.96 / (2 * n)) / w + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / w, 6) AS high FROM p""")
def wilson_events(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    low, high = lab.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return rounded(s.withColumn("low", low).withColumn("high", high))


@query()
def power_grid(spark: SparkSession, d: str) -> DataFrame:
    designs = spark.createDataFrame([(0.8, 2, 26), (0.5, 2, 64), (0.2, 2, 394), (0.25, 3, 53)], "effect double, k int, n int")
    return designs.withColumn("power", F.when(F.col("k") == 2, power.t_power(F.col("n"), F.col("effect"))).otherwise(power.f_power(F.col("n"), F.col("effect"), F.col("k")))).withColumn("n_needed", F.when(F.col("k") == 2, power.n_for_t(F.col("effect"))).otherwise(power.n_for_f(F.col("effect"), F.col("k"))))


@query()
def curve_fits_hourly(spark: SparkSession, d: str) -> DataFrame:
    return curves.fit(_daily(spark, d), "event_type", "t", "v", ["linear", "optimum", "logistic_growth"])


@query()
def lytic_sweep(spark: SparkSession, d: str) -> DataFrame:
    return simulate.sweep(spark, "adsorption", n=5, hours=8.0)


@query()
def gillespie_runs(spark: SparkSession, d: str) -> DataFrame:
    return simulate.gillespie(spark, 16, t_max=5.0, max_events=20_000)


@query()
def extinction_chances(spark: SparkSession, d: str) -> DataFrame:
    return simulate.extinction(spark, (1, 2, 5), 20, t_max=3.0, max_events=5_000)


@query()
def plaque_lattices(spark: SparkSession, d: str) -> DataFrame:
    return simulate.plaque(spark.range(4).withColumnRenamed("id", "run_id"), 61, 40)


@query()
def poisson_plate_counts(spark: SparkSession, d: str) -> DataFrame:
    return simulate.poisson_plates(spark)
