"""Activation pipeline, anti-joins on its result, XLR, epidemics, counterfactuals, plasticity."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import activation, spread
from loomgraph.operators.graph import r6, scaled6
from loomgraph.plans.durable import cut
from loomgraph.queries.registry import query
from loomgraph.sources.tables_graph import full_graph, id_of, spine_graph

SEEDS = ["nation::0", "region::2"]
_SEED_SQL = f"(VALUES ({id_of('nation::0')}::BIGINT), ({id_of('region::2')}::BIGINT)) s(node_id)"


def wave_sql(hops: int, edges: str = "edges", seeds: str = _SEED_SQL, name: str = "s", trial: str = "") -> str:
    """Unrolled synchronous wavefront; ``trial``: an extra key column."""
    t, on = (f"{trial}, ", f" AND a.{trial} = b.{trial}") if trial else ("", "")
    tb = f"coalesce(a.{trial}, b.{trial}) AS {trial}, " if trial else ""
    parts = [f"{name}0 AS MATERIALIZED (SELECT {t}node_id, 1.0::DOUBLE AS act, 0 AS entered FROM {seeds})"]
    for k in range(1, hops + 1):
        p = f"{name}{k - 1}"
        parts.append(
            f"{name}{k} AS MATERIALIZED (SELECT {tb}coalesce(a.node_id, b.dst) AS node_id, greatest(greatest(coalesce(a.act, 0), coalesce(b.up, 0)) - coalesce(b.down, 0), 0.0::DOUBLE) AS act, CASE WHEN a.entered IS NOT NULL THEN a.entered WHEN b.up IS NOT NULL THEN {k} END AS entered "
            f"FROM {p} a FULL JOIN (SELECT {t}dst, max(CASE WHEN NOT inhibitory AND act * weight * 0.55::DOUBLE > 0.04::DOUBLE THEN act * weight * 0.55::DOUBLE END) AS up, sum(CASE WHEN inhibitory THEN act * weight * 0.55::DOUBLE * 0.5::DOUBLE END) AS down "
            f"FROM {p} JOIN {edges} e ON e.src = node_id WHERE entered = {k - 1} AND act >= 0.04::DOUBLE GROUP BY {t}dst) b ON a.node_id = b.dst{on})"
        )
    return ", ".join(parts)


@query(f"WITH {wave_sql(4)} SELECT external_id, round(act, 6) AS activation FROM s4 JOIN nodes USING (node_id) WHERE act > 0")
def g2_wavefront(spark, sf_dir):
    g = full_graph(spark, sf_dir, turns=True).finalised()
    out = activation.wavefront(g, g.seeds(SEEDS), 4, turn="turn")
    return g.named(out, "external_id").select("external_id", scaled6("activation").alias("activation"))


_NOW = 915148800.0


@query(f"SELECT external_id, round(exp(-ln(2.0::DOUBLE) * greatest(({_NOW} - last_modified) / 3600, 0) / 168) * 0.6::DOUBLE * 0.9::DOUBLE, 6) AS activation FROM nodes WHERE node_type = 11 AND node_id % 50 = 0 AND exp(-ln(2.0::DOUBLE) * greatest(({_NOW} - last_modified) / 3600, 0) / 168) > 0")
def g5_temporal(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    seeds = g.nodes.where("node_type = 11 AND node_id % 50 = 0").select("node_id", F.lit(0.9).alias("score"))
    return g.named(activation.temporal(g, seeds, _NOW), "external_id").select("external_id", r6("activation").alias("activation"))


def _causal_sql(hops: int) -> str:
    parts = [f"c0 AS (SELECT node_id, 1.0::DOUBLE AS act FROM {_SEED_SQL})"]
    for d, (a, b, damp) in {"f": ("src", "dst", 1.0), "r": ("dst", "src", 0.7)}.items():
        for k in range(1, hops + 1):
            p = "c0" if k == 1 else f"{d}{k - 1}"
            s = f"act * (weight * causal_strength) * 0.55::DOUBLE * {damp}::DOUBLE"
            parts.append(f"{d}{k} AS (SELECT {b} AS node_id, max({s}) AS act FROM {p} JOIN edges ON {a} = node_id WHERE causal_strength > 0 AND {s} > 0.04::DOUBLE GROUP BY {b})")
    union = " UNION ALL ".join(f"SELECT * FROM {x}" for x in ["c0", *(f"{d}{k}" for d in "fr" for k in range(1, hops + 1))])
    return f"{', '.join(parts)}, causal AS (SELECT node_id, max(act) AS act FROM ({union}) GROUP BY node_id)"


@query(f"WITH {_causal_sql(3)} SELECT external_id, round(act, 6) AS activation FROM causal JOIN nodes USING (node_id)")
def g6_causal(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    return g.named(activation.causal(g, g.seeds(SEEDS), 3), "external_id").select("external_id", r6("activation").alias("activation"))


_MERGED = (
    f"{wave_sql(3)}, {_causal_sql(3)}, tmp AS (SELECT node_id, exp(-ln(2.0::DOUBLE) * greatest(({_NOW} - last_modified) / 3600, 0) / 168) * 0.6::DOUBLE AS act FROM nodes JOIN {_SEED_SQL} USING (node_id)), "
    "dims AS (SELECT node_id, 'structural' AS d, act, 0.35::DOUBLE AS w FROM s3 WHERE act > 0 UNION ALL SELECT node_id, 'temporal', act, 0.25 FROM tmp WHERE act > 0 UNION ALL SELECT node_id, 'causal', act, 0.25 FROM causal), "
    "tot AS (SELECT sum(w) AS total FROM (SELECT DISTINCT d, w FROM dims)), merged AS (SELECT node_id, sum(act * w / total) * CASE WHEN count(*) FILTER (act > 0.01) >= 4 THEN 1.5::DOUBLE WHEN count(*) FILTER (act > 0.01) = 3 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS act, count(*) FILTER (act > 0.01) AS n FROM dims, tot GROUP BY node_id)"
)


def _dimensions(g):
    seeds = g.seeds(SEEDS)
    return {"structural": activation.wavefront(g, seeds, 3, turn="turn" if "turn" in g.edges.columns else None), "temporal": activation.temporal(g, seeds, _NOW), "causal": activation.causal(g, seeds, 3)}


@query(f"WITH {_MERGED} SELECT external_id, round(act, 6) AS activation, CAST(n AS BIGINT) AS n_dimensions FROM merged JOIN nodes USING (node_id)")
def g7_activate(spark, sf_dir):
    g = full_graph(spark, sf_dir, turns=True).finalised()
    out = activation.merge_dimensions(_dimensions(g))
    return g.named(out, "external_id").select("external_id", scaled6("activation").alias("activation"), "n_dimensions")


@query(f"WITH {_MERGED} SELECT external_id, round(act + 0.1::DOUBLE * coalesce(node_type / 100.0::DOUBLE, 0), 6) AS activation FROM (SELECT * FROM merged ORDER BY act DESC, node_id LIMIT 20) JOIN nodes USING (node_id)")
def g8_boosted_top(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    rank = g.nodes.select("node_id", (F.col("node_type") / 100.0).alias("pagerank"))  # any prior in place of PageRank
    out = activation.merge_dimensions(_dimensions(g), 20, rank)
    return g.named(out, "external_id").select("external_id", r6("activation").alias("activation"))


_LOUD = "loud AS (SELECT node_id, ((node_id % 97) / 97.0::DOUBLE) AS act, CASE WHEN node_id % 2 = 0 THEN ['s', 'c', 't'] ELSE ['s', 'c'] END AS dims FROM nodes WHERE node_type IN (12, 13))"


def _loud(g):
    return g.nodes.where("node_type IN (12, 13)").select("node_id", ((F.col("node_id") % 97) / 97.0).alias("activation"), F.when(F.col("node_id") % 2 == 0, F.array(F.lit("s"), F.lit("c"), F.lit("t"))).otherwise(F.array(F.lit("s"), F.lit("c"))).alias("dimensions"))


@query(f"WITH {_LOUD}, best AS (SELECT * FROM loud ORDER BY act DESC, node_id LIMIT 50) SELECT a.node_id AS src, b.node_id AS dst, round(least(sqrt(a.act * b.act), 1.0), 6) AS strength FROM best a JOIN best b ON (a.act > b.act OR (a.act = b.act AND a.node_id < b.node_id)) WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = a.node_id AND dst = b.node_id) ORDER BY strength DESC, src, dst LIMIT 10")
def j9_ghost_edges(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return activation.ghost_edges(g, _loud(g)).withColumn("strength", r6("strength"))


@query(f"WITH {_LOUD}, h AS (SELECT src AS node_id, count(*) AS siblings, avg(act) AS m FROM (SELECT DISTINCT src, dst FROM edges) JOIN loud ON node_id = dst WHERE act > 0.9::DOUBLE GROUP BY src HAVING count(*) >= 2) SELECT node_id, CAST(siblings AS BIGINT) AS siblings, round(m, 6) AS mean_activation FROM h WHERE node_id NOT IN (SELECT node_id FROM loud WHERE act > 0.01::DOUBLE) ORDER BY m DESC, node_id LIMIT 10")
def g9_structural_holes(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return activation.structural_holes(g, _loud(g).drop("dimensions"), 0.9).withColumn("mean_activation", r6("mean_activation"))


@query(
    f"WITH deg AS (SELECT node_id, count(*) FILTER (o = 1) AS out_degree, count(*) AS deg FROM (SELECT src AS node_id, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY node_id), sd AS (SELECT * FROM {_SEED_SQL}), m AS (SELECT avg(deg) AS mean FROM deg JOIN sd USING (node_id)), hood AS (SELECT dst AS node_id FROM edges JOIN sd ON src = node_id UNION SELECT node_id FROM sd), ins AS (SELECT src AS node_id, count(*) AS inside FROM edges WHERE dst IN (SELECT node_id FROM hood) GROUP BY src), "
    "c AS (SELECT node_id, coalesce(inside, 0) / out_degree::DOUBLE AS share, CASE WHEN node_id IN (SELECT node_id FROM hood) THEN 0 ELSE 1 END AS outside FROM deg LEFT JOIN ins USING (node_id), m WHERE deg / mean >= 0.3::DOUBLE AND out_degree > 0 AND node_id NOT IN (SELECT node_id FROM sd)) SELECT node_id, round(share, 6) AS share, round(outside + 1 - share, 6) AS score FROM c WHERE share <= 0.2::DOUBLE ORDER BY outside + 1 - share DESC, node_id LIMIT 3"
)
def g10_anti_seeds(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return activation.anti_seeds(g, g.seeds(SEEDS)).select("node_id", r6("share").alias("share"), r6("score").alias("score"))


@query(f"WITH i0 AS (SELECT node_id FROM {_SEED_SQL}), i1 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN i0 ON src = node_id), i2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN i1 ON src = node_id) SELECT node_id FROM (SELECT * FROM i0 UNION SELECT * FROM i1 UNION SELECT * FROM i2)")
def g11_immunity(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return activation.immunity(g, g.seeds(SEEDS))


def _pulse_sql(hops: int, name: str, seeds: str) -> str:
    parts = [f"{name}0 AS (SELECT node_id, -1::BIGINT AS prev, 1.0::DOUBLE AS amp FROM {seeds})"]
    f = "amp * (weight * 0.55::DOUBLE * CASE WHEN inhibitory THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"
    for k in range(1, hops + 1):
        parts.append(f"{name}{k} AS (SELECT dst AS node_id, src AS prev, {f} AS amp FROM {name}{k - 1} JOIN edges ON src = node_id AND dst <> prev WHERE {f} >= 0.04::DOUBLE)")
    union = " UNION ALL ".join(f"SELECT node_id, amp FROM {name}{k}" for k in range(hops + 1))
    return f"{', '.join(parts)}, {name} AS (SELECT node_id, sum(amp) AS amplitude, count(*) AS paths FROM ({union}) GROUP BY node_id)"


@query(f"WITH {_pulse_sql(3, 'q', _SEED_SQL)} SELECT node_id, round(amplitude, 4) AS amplitude, CAST(paths AS BIGINT) AS paths FROM q")
def g12_spectral_pulses(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    return activation.spectral_pulses(g, g.seeds(SEEDS), 3, budget=None).withColumn("amplitude", F.round("amplitude", 4))


_ANTI = (
    "deg AS (SELECT node_id, count(*) FILTER (o = 1) AS out_degree, count(*) AS deg FROM (SELECT src AS node_id, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY node_id), "
    f"sd AS (SELECT * FROM {_SEED_SQL}), m AS (SELECT avg(deg) AS mean FROM deg JOIN sd USING (node_id)), hood AS (SELECT dst AS node_id FROM edges JOIN sd ON src = node_id UNION SELECT node_id FROM sd), ins AS (SELECT src AS node_id, count(*) AS inside FROM edges WHERE dst IN (SELECT node_id FROM hood) GROUP BY src), "
    "c AS (SELECT node_id, coalesce(inside, 0) / out_degree::DOUBLE AS share, CASE WHEN node_id IN (SELECT node_id FROM hood) THEN 0 ELSE 1 END AS outside FROM deg LEFT JOIN ins USING (node_id), m WHERE deg / mean >= 0.3::DOUBLE AND out_degree > 0 AND node_id NOT IN (SELECT node_id FROM sd)), "
    "antis AS MATERIALIZED (SELECT node_id FROM c WHERE share <= 0.2::DOUBLE ORDER BY outside + 1 - share DESC, node_id LIMIT 3)"
)


@query(
    f"WITH {_ANTI}, {_pulse_sql(2, 'hot', _SEED_SQL)}, {_pulse_sql(2, 'cold', 'antis')}, i1 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN sd ON src = node_id), i2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN i1 ON src = node_id), im AS (SELECT node_id FROM sd UNION SELECT * FROM i1 UNION SELECT * FROM i2), ad AS (SELECT node_id, coalesce(deg, 0)::DOUBLE AS deg FROM nodes LEFT JOIN deg USING (node_id)), "
    "z AS (SELECT node_id, (hot.amplitude - coalesce(k.amplitude, 0)) * least(greatest(deg / (SELECT avg(deg) FROM ad), 0.3), 2) AS net FROM hot LEFT JOIN (SELECT * FROM cold WHERE node_id NOT IN (SELECT node_id FROM im)) k USING (node_id) JOIN ad USING (node_id)), s AS (SELECT node_id, 1 / (1 + exp(-least(greatest(6 * net, -20), 20))) AS score FROM z) SELECT external_id, round(score, 6) AS score FROM s JOIN nodes USING (node_id) WHERE score > 0.01"
)
def g13_xlr(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    return g.named(activation.xlr(g, g.seeds(SEEDS), 2), "external_id").select("external_id", r6("score").alias("score"))


# --- epidemic -------------------------------------------------------------------------------------


def _sir_sql(rounds: int, threshold: float) -> str:
    coupling = "CASE relation WHEN 'imports' THEN 0.8::DOUBLE WHEN 'calls' THEN 0.7::DOUBLE WHEN 'inherits' THEN 0.6::DOUBLE WHEN 'references' THEN 0.4::DOUBLE WHEN 'contains' THEN 0.3::DOUBLE WHEN 'related_to' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END"
    parts = [
        "od AS (SELECT src, count(*) AS deg FROM edges GROUP BY src)",
        f"tr AS MATERIALIZED (SELECT e.src, dst, least(greatest(weight * {coupling}, 0), 0.95::DOUBLE) / CASE WHEN deg > 1 THEN sqrt(deg::DOUBLE) ELSE 1.0::DOUBLE END AS p FROM edges e JOIN od ON od.src = e.src)",
        f"e0 AS (SELECT node_id, 1.0::DOUBLE AS prob, true AS inf FROM {_SEED_SQL})",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"e{k} AS MATERIALIZED (SELECT coalesce(a.node_id, b.dst) AS node_id, CASE WHEN a.inf THEN a.prob ELSE 1 - (1 - coalesce(a.prob, 0)) * coalesce(b.q, 1) END AS prob, coalesce(a.inf, false) OR 1 - (1 - coalesce(a.prob, 0)) * coalesce(b.q, 1) > {threshold}::DOUBLE AS inf "
            f"FROM e{k - 1} a FULL JOIN (SELECT dst, product(1 - p * prob) AS q FROM e{k - 1} JOIN tr ON src = node_id WHERE inf GROUP BY dst) b ON a.node_id = b.dst)"
        )
    return ", ".join(parts)


@query(f"WITH {_sir_sql(3, 0.02)} SELECT external_id, round(prob, 6) AS probability, inf AS infected FROM e3 JOIN nodes USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM {_SEED_SQL}) AND prob > 0.001::DOUBLE")
def g36_epidemic(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    out = spread.epidemic(g, SEEDS, iterations=3, promote=0.02, least=0.001)
    return g.named(out, "external_id").select("external_id", r6("probability").alias("probability"), "infected")


# --- counterfactuals ------------------------------------------------------------------------------

def _rank_sql(nodes: str, edges: str, hops: int, trials: int = 8) -> str:
    """PageRank (exact after ``hops`` steps: the graph has no cycle), and the trials strided over the nodes with out-edges."""
    parts = [f"pn AS (SELECT count(*)::DOUBLE AS n FROM {nodes})", f"pd AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS deg FROM {edges} GROUP BY src)", f"pr0 AS MATERIALIZED (SELECT node_id, 1 / n AS pr FROM {nodes}, pn)"]
    for k in range(1, hops + 1):
        parts.append(f"pr{k} AS MATERIALIZED (SELECT s.node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(m, 0) AS pr FROM {nodes} s CROSS JOIN pn LEFT JOIN (SELECT dst, sum(pr / deg) AS m FROM pr{k - 1} JOIN {edges} e ON e.src = node_id JOIN pd ON pd.src = node_id GROUP BY dst) t ON t.dst = s.node_id)")
    parts.append(f"rk AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY round(pr / (SELECT max(pr) FROM pr{hops}), 9) DESC, node_id) - 1 AS r FROM pr{hops} WHERE node_id IN (SELECT src FROM pd))")
    parts.append(f"tr AS MATERIALIZED (SELECT t AS trial, node_id FROM range({trials}) x(t), (SELECT count(*) AS n FROM rk) c, rk WHERE r = (t * greatest(1, n // {trials})) % n)")
    return ", ".join(parts)


#: The first trial's seed, and the least node that it leads to.
_TOLD = "told AS MATERIALIZED (SELECT node_id AS seed, (SELECT min(dst) FROM edges WHERE src = node_id) AS target FROM tr WHERE trial = 0)"


def _told(g, trials) -> list[str]:
    """The same by external id."""
    seed = trials.where("trial = 0").select("node_id")
    first = g.expanded().join(seed.withColumnRenamed("node_id", "src"), "src").groupBy("src").agg(F.min("dst").alias("dst")).first()
    names = {r["node_id"]: r["external_id"] for r in g.nodes.where(F.col("node_id").isin(first["src"], first["dst"])).select("node_id", "external_id").collect()}
    return [names[first["src"]], names[first["dst"]]]


def _masked(name: str, columns: str, of: str, seeds: str) -> str:
    gone = f"(SELECT unnest([{columns}]) FROM told)"
    return f"{name}e AS MATERIALIZED (SELECT * FROM {of} WHERE src NOT IN {gone} AND dst NOT IN {gone}), {name}t AS MATERIALIZED (SELECT * FROM {seeds} WHERE node_id NOT IN {gone})"


@query(
    f"WITH {_rank_sql('nodes', 'edges', 5)}, {_TOLD}, {_masked('m', 'seed, target', 'edges', 'tr')}, {wave_sql(3, 'edges', 'tr', 'x', 'trial')}, {wave_sql(3, 'me', 'mt', 'y', 'trial')}, "
    "b AS (SELECT node_id, sum(act) AS base FROM x3 WHERE act > 0 GROUP BY node_id), m AS (SELECT node_id, sum(act) AS kept FROM y3 WHERE act > 0 GROUP BY node_id), l AS (SELECT b.node_id, 1 - coalesce(kept, 0) / base AS lost FROM b LEFT JOIN m USING (node_id)) "
    "SELECT external_id, round(lost, 6) AS lost, CASE WHEN lost > 0.99::DOUBLE THEN 'orphaned' WHEN lost > 0.5::DOUBLE THEN 'weakened' ELSE 'kept' END AS state FROM l JOIN nodes USING (node_id) WHERE node_id NOT IN (SELECT unnest([seed, target]) FROM told)"
)
def g31_counterfactual(spark, sf_dir):
    """What the nodes that eight trials reach lose if the first trial's seed and its least target go."""
    g = full_graph(spark, sf_dir).finalised()
    trials = cut(spread.ranked_trials(g))
    out = spread.removal_effect(g, trials, _told(g, trials), max_depth=3)
    return g.named(out, "external_id").select("external_id", r6("lost").alias("lost"), "state")


@query("WITH d AS (SELECT src AS node_id, count(*) AS o FROM edges GROUP BY src), i AS (SELECT dst AS node_id, count(*) AS i FROM edges GROUP BY dst) SELECT external_id, CAST(least(coalesce(o, 0), coalesce(i, 0)) AS BIGINT) AS alternatives FROM nodes LEFT JOIN d USING (node_id) LEFT JOIN i USING (node_id) WHERE node_type IN (13, 14)")
def g35_redundancy(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    d = g.named(g.degrees(), "external_id", "node_type").where("node_type IN (13, 14)")
    return d.select("external_id", F.least("out_degree", "in_degree").alias("alternatives"))


# The spine is a forest: a node is reached from a trial's seed along one path, of 1, 0.55 and 0.3025.
_FOREST = (
    "st AS MATERIALIZED (SELECT node_id AS seed FROM tr), h1 AS MATERIALIZED (SELECT seed, dst AS mid FROM st JOIN spine_edges ON src = seed), h2 AS MATERIALIZED (SELECT seed, mid, dst AS leaf FROM h1 JOIN spine_edges ON src = mid), "
    "base AS (SELECT (SELECT count(*) FROM st) + 0.55::DOUBLE * (SELECT count(*) FROM h1) + 0.3025::DOUBLE * (SELECT count(*) FROM h2) AS base), "
    "gone AS MATERIALIZED (SELECT node_id AS candidate FROM (SELECT node_id, count(src) AS o FROM spine_nodes LEFT JOIN spine_edges ON src = node_id GROUP BY node_id) ORDER BY o DESC, node_id LIMIT 10), "
    "lost AS (SELECT candidate, (SELECT count(*) FROM st WHERE seed = candidate) + 0.55::DOUBLE * (SELECT count(*) FROM h1 WHERE candidate IN (seed, mid)) + 0.3025::DOUBLE * (SELECT count(*) FROM h2 WHERE candidate IN (seed, mid, leaf)) AS lost FROM gone)"
)


@query(f"WITH {_rank_sql('spine_nodes', 'spine_edges', 3)}, {_FOREST} SELECT external_id, round(lost / base, 6) AS impact FROM lost JOIN spine_nodes ON node_id = candidate, base ORDER BY round(lost / base, 9) DESC, candidate LIMIT 5")
def g32_keystones(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return g.named(spread.keystones(g, candidates=10, keep=5, max_depth=2), "external_id").select("external_id", r6("impact").alias("impact"))


@query(
    f"WITH {_rank_sql('nodes', 'edges', 5)}, {_TOLD}, {_masked('ma', 'seed', 'edges', 'tr')}, {_masked('mb', 'target', 'edges', 'tr')}, {_masked('mc', 'seed, target', 'edges', 'tr')}, "
    f"{wave_sql(3, 'edges', 'tr', 'x', 'trial')}, {wave_sql(3, 'mae', 'mat', 'y', 'trial')}, {wave_sql(3, 'mbe', 'mbt', 'z', 'trial')}, {wave_sql(3, 'mce', 'mct', 'w', 'trial')}, base AS (SELECT sum(act) AS base FROM x3), "
    "l AS (SELECT 1 - (SELECT sum(act) FROM y3) / base AS a, 1 - (SELECT sum(act) FROM z3) / base AS b, 1 - (SELECT sum(act) FROM w3) / base AS c FROM base), s AS (SELECT c AS combined, a + b AS single FROM l) "
    "SELECT round(combined, 6) AS combined, round(single, 6) AS single, round(CASE WHEN single > 0 THEN least(combined / single, 10) ELSE 1 END, 6) AS synergy FROM s"
)
def g34_synergy(spark, sf_dir):
    """The first trial's seed and a node that it leads to: what both cost together is less than the sum."""
    g = full_graph(spark, sf_dir)
    trials = cut(spread.ranked_trials(g))
    return spread.synergy(g, _told(g, trials), max_depth=3, ranked=trials)


# --- plasticity -----------------------------------------------------------------------------------


@query(
    "WITH act AS (SELECT node_id, (node_id % 10) / 10.0::DOUBLE AS a FROM nodes WHERE node_type IN (12, 13, 14) AND node_id % 10 > 4), p AS (SELECT relation, src, dst, weight AS w0, x.a AS xs, y.a AS ys, (dst % 6) AS sc, (src % 6) AS wc FROM edges e LEFT JOIN act x ON x.node_id = src LEFT JOIN act y ON y.node_id = dst), "
    "q AS (SELECT *, CASE WHEN xs IS NOT NULL AND ys IS NOT NULL THEN least(w0 + 0.08::DOUBLE * xs * ys, 3.0) WHEN xs IS NULL AND w0 - greatest(w0 * 0.995::DOUBLE, 0.05) > 0.000001::DOUBLE THEN greatest(w0 * 0.995::DOUBLE, 0.05) ELSE w0 END AS w1, sc + CASE WHEN xs IS NOT NULL AND ys IS NOT NULL THEN 1 ELSE 0 END AS sc1, wc + CASE WHEN xs IS NULL AND w0 - greatest(w0 * 0.995::DOUBLE, 0.05) > 0.000001::DOUBLE THEN 1 ELSE 0 END AS wc1 FROM p), "
    "r AS (SELECT *, CASE WHEN sc1 >= 5 THEN least(w1 + 0.15::DOUBLE, 3.0) ELSE w1 END AS w2 FROM q), t AS (SELECT *, CASE WHEN wc1 >= 5 THEN greatest(w2 - 0.15::DOUBLE, 0.05) ELSE w2 END AS w3 FROM r), z AS (SELECT *, w3 * CASE WHEN sum(w3) OVER (PARTITION BY dst) > 5 THEN 5 / sum(w3) OVER (PARTITION BY dst) ELSE 1.0::DOUBLE END AS w4 FROM t) "
    "SELECT relation, CAST(count(*) AS BIGINT) AS n, round(sum(w4), 3) AS weight, CAST(count(*) FILTER (sc1 > sc) AS BIGINT) AS strengthened, CAST(count(*) FILTER (wc1 > wc) AS BIGINT) AS weakened FROM z GROUP BY relation"
)
def g48_plasticity(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    active = g.nodes.where("node_type IN (12, 13, 14) AND node_id % 10 > 4").select("node_id", ((F.col("node_id") % 10) / 10.0).alias("activation"))
    state = g.edges.withColumns({"strengthen_count": (F.col("dst") % 6).cast("int"), "weaken_count": (F.col("src") % 6).cast("int"), "ltp_applied": F.lit(False), "ltd_applied": F.lit(False)})
    out = spread.hebbian_update(state, active)
    return out.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"),
        F.count_if(F.col("strengthen_count") > F.col("dst") % 6).alias("strengthened"), F.count_if(F.col("weaken_count") > F.col("src") % 6).alias("weakened"),
    )


_LEARNT = f"{id_of('nation::4')}, {id_of('region::4')}"


@query(f"WITH r AS (SELECT node_id FROM nodes WHERE node_id IN ({_LEARNT}) UNION SELECT dst FROM edges WHERE relation = 'contains' AND src IN ({_LEARNT})) SELECT src, dst, relation, round(least(greatest(weight + 0.2::DOUBLE, 0.05), 3.0), 6) AS weight FROM edges WHERE src IN (SELECT node_id FROM r) AND dst IN (SELECT node_id FROM r)")
def g49_learn(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return spread.learn(g, ["nation::4", "region::4"], "correct").select("src", "dst", "relation", r6("weight").alias("weight"))


@query("SELECT src, dst, relation, round(0.1::DOUBLE + (dst % 3) / 10.0::DOUBLE, 6) AS drift FROM edges WHERE relation = 'calls' AND dst % 9 = 0 ORDER BY drift DESC, src, dst LIMIT 20")
def g50_drift(spark, sf_dir):
    e = full_graph(spark, sf_dir).edges.where("relation = 'calls'")
    now = e.withColumn("weight", F.expr("CASE WHEN dst % 9 = 0 THEN weight + 0.1D + (dst % 3) / 10.0D ELSE weight END"))
    return spread.weight_drift(e, now).withColumn("drift", r6("drift"))


@query("WITH pairs AS (SELECT src, dst, relation, weight FROM edges WHERE relation IN ('imports', 'calls', 'references')) SELECT external_id, round(max(weight) * 0.98::DOUBLE, 6) AS score FROM (SELECT dst AS node_id, weight FROM pairs WHERE src = " + str(id_of("supplier::4")) + " UNION ALL SELECT src, weight FROM pairs WHERE dst = " + str(id_of("supplier::4")) + ") JOIN nodes USING (node_id) GROUP BY external_id ORDER BY score DESC, external_id LIMIT 10")
def g45_predict(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    none = spark.createDataFrame([], "a long, b long, strength double")
    out = spread.predict(g, "supplier::4", none)
    return g.named(out, "external_id").select("external_id", r6("score").alias("score")).orderBy(F.desc("score"), "external_id").limit(10)


@query(
    "WITH b1 AS (SELECT src, dst, weight * 0.95::DOUBLE * 0.3::DOUBLE AS s FROM spine_edges), b2 AS (SELECT b1.src, e.dst, max(s * weight * 0.95::DOUBLE * 0.3::DOUBLE) AS s FROM b1 JOIN spine_edges e ON e.src = b1.dst GROUP BY ALL) SELECT src, dst, round(s, 6) AS strength FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) WHERE s > 0.001::DOUBLE QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 100"
)
def g43_co_change_bootstrap(spark, sf_dir):
    return spread.bootstrap_co_change(spine_graph(spark, sf_dir), 2).withColumnRenamed("a", "src").withColumnRenamed("b", "dst").withColumn("strength", r6("strength"))
