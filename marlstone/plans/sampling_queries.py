"""Queries of training pairs, hard negatives and simulated competitors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import competitors as K
from ..operators import location as L
from ..operators import pairs as P
from ..sources.stages import checkpointed, kept
from .registry import query, table
from .search_queries import CEN, SLOT, TRAIN, TRANS, VECTORS, Prepared, Stage, hashed_vectors, hist_sql, md5_sql, u_sql

CAP, SKIP, TOP, BATCH, POOL, FIRST = 30, 3, 30, 16, 150, 5000
#: The number of the first copy, above all rows of the corpus.
FIRST_COPY = 1_000_000
PAIRS = f"""dp as materialized (select * exclude (rn) from (select *, row_number() over (partition by search_query, search_infm_params_text, item_id order by row_key) as rn from hist) where rn = 1),
cp as materialized (select * exclude (rn) from (select *, row_number() over (partition by search_query order by {md5_sql('cap', 'row_key')}, row_key) as rn from dp) where rn <= {CAP}),
pi as materialized (select * exclude (rn) from (select *, row_number() over (partition by item_id order by row_key) as rn from cp) where rn = 1),
ch as materialized (select distinct search_query, row_id from cp)"""
NEG = f"""pv as (select row_key, search_query, item_location_id as loc, embedding::double[] as vec from cp join embeddings on vec_id = {SLOT.format(t='search_query')}),
ivx as (select row_id, item_location_id as loc, embedding::double[] as vec from pi join embeddings on vec_id = row_id % {VECTORS}),
near as (select * from (select row_key, search_query, row_id, row_number() over (partition by row_key order by sim desc, row_id) as rank from (select row_key, search_query, row_id, round(list_dot_product(pv.vec, ivx.vec), 6) as sim from pv join ivx using (loc))) where rank <= {TOP + 5}),
rest as (select *, row_number() over (partition by row_key order by rank) - 1 as r from near where (search_query, row_id) not in (select (search_query, row_id) from ch)),
hn as materialized (select row_key, row_id as neg from (select *, row_number() over (partition by row_key order by {md5_sql('neg', 'row_key', 'row_id')}) as rn from rest where r >= {SKIP} and r < {TOP}) where rn = 1)"""


class Pairs(Stage):
    """Pairs with the columns that their queries read: no step sorts or keeps the others."""

    def __init__(self, spark, sf):
        self.base = Prepared.of(spark, sf)
        self.spark, self.sf = spark, sf
        self.distinct = P.distinct_pairs(self.hist.select(*P.PAIR_COLUMNS)).drop("search_infm_params_text")

    @cached_property
    def capped(self):
        return kept(P.cap_pairs(self.distinct, CAP), "pairs")

    def negatives(self):
        e = table(self.spark, self.sf, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vec"))
        items = P.pair_items(self.capped).select("row_id", F.col("item_location_id").alias("loc")).withColumn("slot", F.col("row_id") % e.count()).join(e, "slot")
        texts = hashed_vectors(self.spark, self.sf, self.capped.select("search_query").distinct(), "search_query")
        return P.hard_negatives(self.capped.withColumnRenamed("item_location_id", "loc"), texts, items, P.chosen_by_text(self.capped), SKIP, TOP)


def pair_sql(body: str, *more: str) -> str:
    return hist_sql(PAIRS, *more) + " " + body


@query("h1_distinct_pairs", pair_sql("select row_key, search_query, item_id from dp"), TRAIN)
def h1(spark, sf):
    return Pairs.of(spark, sf).distinct.select("row_key", "search_query", "item_id")


@query("h2_cap_pairs", pair_sql("select row_key, search_query from cp"), TRAIN)
def h2(spark, sf):
    return Pairs.of(spark, sf).capped.select("row_key", "search_query")


@query("h3_pair_items", pair_sql("select row_key, item_id, row_id from pi"), TRAIN)
def h3(spark, sf):
    return P.pair_items(Pairs.of(spark, sf).capped).select("row_key", "item_id", "row_id")


@query("h4_chosen_by_text", pair_sql("select * from ch"), TRAIN)
def h4(spark, sf):
    return P.chosen_by_text(Pairs.of(spark, sf).capped)


@query("h5_hard_negatives", pair_sql("select * from hn", NEG), TRAIN)
def h5(spark, sf):
    return Pairs.of(spark, sf).negatives()


@query(
    "h6_fill_negatives",
    pair_sql(f"select row_key, coalesce(neg, spare) as neg, neg is not null as hard from (select row_key, row_number() over (order by row_key) as n from cp) join (select row_id as spare, row_number() over (order by {md5_sql('fill', 'row_key')}, row_key) as n from cp) using (n) left join hn using (row_key)", NEG),
    TRAIN,
)
def h6(spark, sf):
    p = Pairs.of(spark, sf)
    return P.fill_negatives(p.capped, p.negatives())


@query(
    "h7_unique_batches",
    pair_sql(
        f"select row_key, search_query, layer, b as batch from (select *, (row_number() over (partition by layer order by {md5_sql('batch', 'row_key')}, row_key) - 1) // {BATCH} as b, count(*) over (partition by layer) as size from ly) where (b + 1) * {BATCH} <= size",
        f"ly as (select row_key, search_query, row_number() over (partition by search_query order by {md5_sql('layer', 'row_key')}, row_key) as layer from cp)",
    ),
    TRAIN,
)
def h7(spark, sf):
    return P.unique_batches(Pairs.of(spark, sf).capped, BATCH)


# --- K: competitors ---

KV = f"""qvx as materialized (select qid, fold, rel, search_location_id as loc, embedding::double[] as vec from allq join embeddings on vec_id = {SLOT.format(t='search_query')}),
cvx as materialized (select row_id, item_id, item_location_id as loc, in_bench, embedding::double[] as vec from corpus join embeddings on vec_id = row_id % {VECTORS}),
rels as (select qid, unnest(rel) as item_id from (select qid, rel from allq where rel is not null order by qid limit {FIRST})),
th as materialized (select round(quantile_cont(round(list_dot_product(qvx.vec, cvx.vec), 6), 0.25), 6) as threshold from rels join qvx using (qid) join cvx using (item_id))"""
TH = "(select threshold from th)"
EXC = f"""bq as materialized (select *, row_number() over (order by qid) as n from qvx where fold = -1), aw as (select loc as away, row_number() over (order by {md5_sql('shuffle', 'qid')}, qid) as n from qvx where fold = -1),
exc as materialized (select qid, greatest(0, sum(case when i.loc = bq.loc then 1 else 0 end) - sum(case when i.loc = away then 1 else 0 end))::bigint as excess
  from bq join aw using (n) left join (select row_id, loc, vec from cvx where in_bench) i on (i.loc = bq.loc or i.loc = away) and round(list_dot_product(bq.vec, i.vec), 6) >= {TH} group by qid),
want as materialized (select qid, excess as n from (select qid, floor({u_sql('excess', 'qid')} * (select count(*) from exc))::bigint as k from allq where fold >= 0) join (select excess, row_number() over (order by qid) - 1 as k from exc) using (k))"""
PICK = f"""pool as (select * from (select qid, row_id, row_number() over (partition by qid order by sim desc, row_id) as rank from (select q.qid, i.row_id, round(list_dot_product(q.vec, i.vec), 6) as sim from qvx q join cvx i on i.in_bench and i.loc <> q.loc where q.qid in (select qid from want where n > 0)) where sim >= {TH}) where rank <= {POOL}),
pick as materialized (select qid, row_id from (select pool.*, n, row_number() over (partition by qid order by {md5_sql('pick', 'qid', 'row_id')}, row_id) as rn from pool join want using (qid)) where rn <= n)"""
PLACE = f"""sh as (select s, l, sum(c) over (partition by s order by l)::double / sum(c) over (partition by s) as hi, (sum(c) over (partition by s order by l) - c)::double / sum(c) over (partition by s) as lo from tr),
placed as materialized (select p.qid, p.row_id, p.s, coalesce(l, p.s) as loc from (select qid, row_id, search_location_id as s, {u_sql('loc', 'qid', 'row_id')} as u from pick join allq using (qid)) p left join sh on sh.s = p.s and u >= lo and u < hi)"""
Z = "sqrt(-2.0::double * ln(1.0::double - {r})) * cos(2.0::double * pi() * {a})"
Z1 = Z.format(r=u_sql("lat|r", "qid", "row_id"), a=u_sql("lat|a", "qid", "row_id"))
Z2 = Z.format(r=u_sql("lon|r", "qid", "row_id"), a=u_sql("lon|a", "qid", "row_id"))
COORD = f"""pts as (select loc, lat, lon, row_number() over (partition by loc order by lat, lon) - 1 as k, count(*) over (partition by loc) as cnt from (select item_location_id as loc, item_latitude as lat, item_longitude as lon from corpus union all select item_location_id, item_latitude, item_longitude from hist) where lat is not null and lon is not null),
cnts as (select distinct loc, cnt from pts), kk as (select placed.*, floor({u_sql('point', 'qid', 'row_id')} * cnt)::bigint as k from placed left join cnts using (loc)),
coord as materialized (select qid, row_id, kk.loc, coalesce(pts.lat + {Z1} * 0.003::double, coalesce(own_.lat, away_.lat) + {Z1} * 0.03::double) as lat, coalesce(pts.lon + {Z2} * 0.003::double, coalesce(own_.lon, away_.lon) + {Z2} * 0.05::double) as lon
  from kk left join pts on pts.loc = kk.loc and pts.k = kk.k left join cen own_ on own_.loc = kk.loc left join cen away_ on away_.loc = kk.s),
comp as materialized (select fold, qid, row_id as src_row, loc, round(lat, 6) as lat, round(lon, 6) as lon from coord join allq using (qid))"""
KALL = (CEN, TRANS, KV, EXC, PICK, PLACE, COORD)


class Competitors(Stage):
    def __init__(self, spark, sf):
        self.base = Prepared.of(spark, sf)
        self.done = {}
        self.query_vectors = hashed_vectors(spark, sf, self.queries.select("qid", "fold", "search_query", F.col("search_location_id").alias("loc")), "search_query")
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vec"))
        self.item_vectors = self.corpus.select("row_id", "in_bench", F.col("item_location_id").alias("loc")).withColumn("slot", F.col("row_id") % e.count()).join(e, "slot").drop("slot")
        self.bench_vectors = self.item_vectors.where("in_bench").drop("in_bench")

    def once(self, name, make):
        if name not in self.done:
            self.done[name] = checkpointed(make())
        return self.done[name]

    def threshold(self):
        found = K.sim_threshold(self.queries, self.query_vectors, self.item_vectors, self.corpus, first=FIRST)
        return self.once("threshold", lambda: found.withColumn("threshold", F.round("threshold", 6)))

    def least(self):
        return self.threshold().first()["threshold"]

    def excess(self):
        return self.once("excess", lambda: K.bench_excess(self.query_vectors.where("fold = -1"), self.bench_vectors, self.least()))

    def picks(self):
        wanted = self.once("wanted", lambda: K.draw_excess(self.queries, self.excess()))
        return self.once("picks", lambda: K.pick_competitors(self.query_vectors, self.bench_vectors, wanted, self.least(), POOL))

    def placed(self):
        picks = self.picks().join(self.queries.select("qid", F.col("search_location_id").alias("s")), "qid")
        return K.draw_location(picks, L.transitions(self.hist))

    def competitors(self):
        centres = L.centroids(self.hist, self.items)
        placed = K.draw_coordinates(self.placed(), K.location_points(self.hist, self.corpus), centres)
        return K.competitors(placed, self.queries).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


def comp_sql(body: str) -> str:
    return hist_sql(*KALL) + " " + body


@query("k1_sim_threshold", comp_sql("select threshold from th"), TRAIN)
def k1(spark, sf):
    return Competitors.of(spark, sf).threshold()


@query("k2_bench_excess", comp_sql("select * from exc"), TRAIN)
def k2(spark, sf):
    return Competitors.of(spark, sf).excess()


@query("k3_draw_excess", comp_sql("select * from want"), TRAIN)
def k3(spark, sf):
    c = Competitors.of(spark, sf)
    return K.draw_excess(c.queries, c.excess())


@query("k4_pick_competitors", comp_sql("select * from pick"), TRAIN)
def k4(spark, sf):
    return Competitors.of(spark, sf).picks()


@query("k5_draw_location", comp_sql("select qid, row_id, loc from placed"), TRAIN)
def k5(spark, sf):
    return Competitors.of(spark, sf).placed().select("qid", "row_id", "loc")


@query("k6_draw_coordinates", comp_sql("select qid, src_row, lat, lon from comp"), TRAIN)
def k6(spark, sf):
    return Competitors.of(spark, sf).competitors().select("qid", "src_row", "lat", "lon")


@query("k7_competitor_stats", comp_sql("select avg(excess) as mean, median(excess) as median, quantile_cont(excess, 0.9) as p90, round((select count(*) from comp)::double / (select count(*) from allq where fold >= 0), 6) as copies_per_query from exc"), TRAIN)
def k7(spark, sf):
    c = Competitors.of(spark, sf)
    return K.competitor_stats(checkpointed(c.excess()), c.competitors(), c.queries).withColumn("copies_per_query", F.round("copies_per_query", 6))


@query(
    "k8_extend_corpus",
    comp_sql("select row_id, null::bigint as src_row, item_id, item_location_id, item_latitude, folds, in_bench from corpus union all select " + str(FIRST_COPY) + " + row_number() over (order by fold, qid, src_row) - 1, src_row, item_id, loc, lat, [fold::bigint], false from comp join corpus on row_id = src_row"),
    TRAIN,
)
def k8(spark, sf):
    c = Competitors.of(spark, sf)
    return K.extend_corpus(c.corpus, c.competitors(), FIRST_COPY).select("row_id", "src_row", "item_id", "item_location_id", "item_latitude", "folds", "in_bench")
