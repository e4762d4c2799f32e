"""Queries of fold preparation, locations, history and vectors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import dense as D
from ..operators import history as H
from ..operators import location as L
from ..operators import prepare as P
from ..sources.stages import checkpointed, kept
from ..sources.tables import GROUP_KEY
from .registry import query, table, view

FOLDS, PER_FOLD = 7, 2500
N_VAL = FOLDS * PER_FOLD
#: The stand-in vectors are far apart, so that near means less than for texts.
NEIGHBOURS, NEAR = 30, 0.2
GK = ", ".join(GROUP_KEY)
ITEMS = ["bench_items_v"]
TRAIN = ["train_v", "bench_items_v", "bench_queries_v"]


def md5_sql(tag: str, *cols: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', '{tag}', " + ", ".join(f"cast({c} as varchar)" for c in cols) + "))"


def u_sql(tag: str, *cols: str, seed: int = 42) -> str:
    return f"(('0x' || substr({md5_sql(tag, *cols, seed=seed)}, 1, 12))::bigint::double / 281474976710656.0::double)"


GID = "md5(concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '<null>')" for c in GROUP_KEY) + "))"
PREP = f"""tg as materialized (select *, {GID} as gid from train_v),
gr as materialized (select gid, {GK}, count(*) as n from tg group by all),
tx as (select search_query from gr group by 1 order by {md5_sql('text', 'search_query')}, search_query limit {N_VAL}),
one as (select * from (select *, row_number() over (partition by search_query order by {md5_sql('group', 'gid')}, gid) as rn from gr where search_query in (select search_query from tx)) where rn = 1),
fo as materialized (select gid, {GK}, n, cast((row_number() over (order by {md5_sql('fold', 'gid')}, gid) - 1) % {FOLDS} as int) as fold from one),
fq as materialized (select *, concat('v', fold, '_', substr(gid, 1, 13)) as qid from fo),
held as materialized (select tg.*, qid, fold from tg join fq using (gid)),
hist as materialized (select * exclude (gid) from tg where gid not in (select gid from fq)),
val as materialized (select qid, fold, {', '.join(f'held.{c}' for c in GROUP_KEY)}, list_sort(list_distinct(list(item_id))) as rel from held group by all),
allq as materialized (select qid, fold, {GK}, rel from val union all select query_id, -1, {GK}, null from bench_queries_v),
extra as materialized (select h.* exclude (rn, qid, fold, row_key, gid, {GK}), f.folds from
   (select *, row_number() over (partition by item_id order by row_key) as rn from held where item_id not in (select item_id from bench_items_v)) h
   join (select item_id, list_sort(list_distinct(list(fold::bigint))) as folds from held group by 1) f using (item_id) where rn = 1),
corpus as materialized (select *, cast(null as bigint[]) as folds, true as in_bench from bench_items_v union all by name select *, false as in_bench from extra)"""


_made: dict = {}


class Stage:
    """Tables that the queries of one session and folder share. Each is made when it is first asked for, by it or its ``base``."""

    base = None

    @classmethod
    def of(cls, spark, sf):
        """The tables of this session and folder, made once: later queries read what earlier ones have kept."""
        place = (spark.sparkContext.applicationId, sf)
        for old in [k for k in _made if k[1:] != place]:
            del _made[old]
        if (cls, *place) not in _made:
            _made[(cls, *place)] = cls(spark, sf)
        return _made[(cls, *place)]

    def __getattr__(self, name):
        base = self.__dict__.get("base")
        if base is None or name.startswith("__"):
            raise AttributeError(name)
        return getattr(base, name)


class Prepared(Stage):
    """The tables of the preparation over the stand-ins; those that many steps read are kept in the shared folder.

    A query that needs only the groups or the sampled texts keeps no choices: the view gives it the columns it reads.
    """

    keep = staticmethod(kept)

    def __init__(self, spark, sf):
        self.train, self.items, self.bench = (view(spark, sf, v) for v in ("train_v", "bench_items_v", "bench_queries_v"))
        self.groups = P.search_groups(self.train)

    @cached_property
    def texts(self):
        return self.keep(P.sample_texts(self.train, N_VAL))

    @cached_property
    def one(self):
        return P.one_per_text(P.search_groups(self.train.join(self.texts, "search_query", "left_semi")), self.texts)

    @cached_property
    def folded(self):
        return P.assign_folds(self.one, FOLDS)

    @cached_property
    def named(self):
        return self.keep(P.fold_qid(self.folded))

    @cached_property
    def marked(self):
        return self.keep(P.mark_held(self.train, self.named))

    @cached_property
    def held(self):
        return P.held_part(self.marked)

    @cached_property
    def hist(self):
        return P.history_part(self.marked)

    @cached_property
    def val(self):
        return P.validation_queries(self.held)

    @cached_property
    def queries(self):
        return self.keep(P.all_queries(self.val, self.bench))

    @cached_property
    def extra(self):
        return P.extra_items(self.held, self.items)

    @cached_property
    def corpus(self):
        return self.keep(P.build_corpus(self.items, self.extra))


def prep(body: str) -> str:
    return f"with {PREP} {body}"


# --- G: folds ---


@query("g1_search_groups", prep("select * from gr"), TRAIN)
def g1(spark, sf):
    return Prepared.of(spark, sf).groups


@query("g2_sample_texts", prep("select * from tx"), TRAIN)
def g2(spark, sf):
    return Prepared.of(spark, sf).texts


@query("g3_one_per_text", prep("select * exclude (rn) from one"), TRAIN)
def g3(spark, sf):
    return Prepared.of(spark, sf).one


@query("g4_assign_folds", prep("select gid, fold from fo"), TRAIN)
def g4(spark, sf):
    return Prepared.of(spark, sf).folded.select("gid", "fold")


@query("g5_fold_qid", prep("select gid, qid from fq"), TRAIN)
def g5(spark, sf):
    return Prepared.of(spark, sf).named.select("gid", "qid")


@query("g6_split_history", prep("select 'held' as part, row_key, qid from held union all select 'history', row_key, null from hist"), TRAIN)
def g6(spark, sf):
    p = Prepared.of(spark, sf)
    return p.held.select(F.lit("held").alias("part"), "row_key", "qid").unionByName(p.hist.select(F.lit("history").alias("part"), "row_key", F.lit(None).cast("string").alias("qid")))


@query("g7_validation_queries", prep("select * from val"), TRAIN)
def g7(spark, sf):
    return Prepared.of(spark, sf).val


@query("g8_all_queries", prep("select * from allq"), TRAIN)
def g8(spark, sf):
    return Prepared.of(spark, sf).queries


@query("g9_extra_items", prep("select row_id, item_id, item_location_id, folds from extra"), TRAIN)
def g9(spark, sf):
    return Prepared.of(spark, sf).extra.select("row_id", "item_id", "item_location_id", "folds")


@query("g10_build_corpus", prep("select row_id, item_id, item_microcat_id, folds, in_bench from corpus"), TRAIN)
def g10(spark, sf):
    return Prepared.of(spark, sf).corpus.select("row_id", "item_id", "item_microcat_id", "folds", "in_bench")


@query("g11_visible", prep("select q.fold, c.row_id from (select distinct fold from allq) q join corpus c on c.in_bench or list_contains(c.folds, q.fold)"), TRAIN)
def g11(spark, sf):
    p = Prepared.of(spark, sf)
    folds = p.queries.select("fold").distinct()
    return p.corpus.join(F.broadcast(folds), P.visible(F.col("fold"), F.col("in_bench"), F.col("folds"))).select("fold", "row_id")


@query(
    "g12_seen_stats",
    prep("select round(avg(case when search_query in (select search_query from hist) then 1.0 else 0.0 end), 9) as seen_text, round(avg(case when (search_query, search_location_id) in (select (search_query, search_location_id) from hist) then 1.0 else 0.0 end), 9) as seen_text_loc from val"),
    TRAIN,
)
def g12(spark, sf):
    p = Prepared.of(spark, sf)
    s = P.seen_stats(p.val, p.hist)
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


# --- I: locations ---

CEN = """pl as (select item_location_id as loc, item_latitude as lat, item_longitude as lon from bench_items_v union all select item_location_id, item_latitude, item_longitude from hist),
own as (select loc, median(lat) as lat, median(lon) as lon from pl where loc is not null and lat is not null and lon is not null group by loc),
cen as materialized (select * from own union all select search_location_id, median(item_latitude), median(item_longitude) from hist where item_latitude is not null and item_longitude is not null and search_location_id not in (select loc from own) group by 1)"""
TRANS = """tr as materialized (select search_location_id as s, item_location_id as l, count(*) as c from hist group by all),
tot as materialized (select s, sum(c)::bigint as total, sum(case when s = l then c else 0 end)::double / sum(c) as self_share from tr group by s)"""
LP = "case when total is null then case when {s} = {l} then ln(0.8::double) else ln(0.0001::double) end else ln((coalesce(c, 0)::double + 0.001::double) / (total + 1)) end"


@query("i1_centroids", prep("").rstrip() + f", {CEN} select loc, round(lat, 6) as lat, round(lon, 6) as lon from cen", TRAIN)
def i1(spark, sf):
    p = Prepared.of(spark, sf)
    return L.centroids(p.hist, p.items).select("loc", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("i2_transitions", prep("").rstrip() + f", {TRANS} select * from tr", TRAIN)
def i2(spark, sf):
    return L.transitions(Prepared.of(spark, sf).hist)


@query("i3_location_totals", prep("").rstrip() + f", {TRANS} select s, total, round(self_share, 9) as self_share from tot", TRAIN)
def i3(spark, sf):
    return L.location_totals(L.transitions(Prepared.of(spark, sf).hist)).withColumn("self_share", F.round("self_share", 9))


@query(
    "i4_log_prior",
    prep("").rstrip() + f", {TRANS}, sl as (select s, l from (select distinct search_location_id as s from allq) cross join (select distinct item_location_id as l from corpus)) select s, l, round({LP.format(s='s', l='l')}, 6) as lp from sl left join tot using (s) left join tr using (s, l)",
    TRAIN,
)
def i4(spark, sf):
    p = Prepared.of(spark, sf)
    t = L.transitions(p.hist)
    pairs = p.queries.select(F.col("search_location_id").alias("s")).distinct().crossJoin(F.broadcast(p.corpus.select(F.col("item_location_id").alias("l")).distinct()))
    return L.log_prior(pairs, t, L.location_totals(t)).select("s", "l", F.round("lp", 6).alias("lp"))


@query("i5_items_per_location", prep("select item_location_id as loc, count(*) as n_items from corpus where in_bench group by 1"), TRAIN)
def i5(spark, sf):
    return L.items_per_location(Prepared.of(spark, sf).corpus)


# --- J: history ---

#: How many vectors there are: texts and items are dealt to all of them.
VECTORS = "(select count(*) from embeddings)"
SLOT = "(('0x' || substr(md5({t}), 1, 12))::bigint % " + VECTORS + ")"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
TEXTVEC = f"""htx as materialized (select text, embedding as vec from (select distinct search_query as text from hist) join embeddings on vec_id = {SLOT.format(t='text')}),
qv as materialized (select qid, fold, search_query, search_location_id, embedding as vec from allq join embeddings on vec_id = {SLOT.format(t='search_query')}),
nb as materialized (select qid, text, sim from (select *, row_number() over (partition by qid order by sim desc, text) as rn from (select qid, text, round({DOT.format(a='qv.vec', b='htx.vec')}, 6) as sim from qv cross join htx)) where rn <= {NEIGHBOURS})"""
PMC = "pmc as materialized (select text, mc, c::double / sum(c) over (partition by text) as p from (select search_query as text, item_microcat_id as mc, count(*) as c from hist group by all))"
TI = "ti as materialized (select h.search_query as text, c.row_id, h.search_location_id as loc, count(*) as c from hist h join corpus c using (item_id) group by all)"
HS = f"""hs as materialized (select qid, row_id, sum(sim * c * case when ti.loc = search_location_id then 1.0::double else 0.3::double end) as hist_knn,
   sum(case when ti.text = search_query then c else 0 end)::double as hist_exact, sum(case when ti.text = search_query and ti.loc = search_location_id then c else 0 end)::double as hist_exact_same
   from nb join ti using (text) join allq using (qid) join corpus using (row_id) where sim >= {NEAR} and (in_bench or coalesce(list_contains(folds, fold), false)) group by qid, row_id)"""
MIX = """mix as materialized (with e as (select *, exp((sim - max(sim) over (partition by qid)) / 0.05::double) as e from nb), s as (select *, e / sum(e) over (partition by qid) as share from e)
   select qid, mc, sum(share * p) as p from s join pmc using (text) group by all)"""
HISTORY = ["train_v", "bench_items_v", "bench_queries_v"]


def hashed_vectors(spark, sf, df, text_col, shift=0):
    """``df`` with a vector picked from the embeddings by a hash of the text: a stand-in for an encoder."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vec"))
    slot = F.pmod(F.conv(F.substring(F.md5(text_col), 1, 12), 16, 10).cast("long") + shift, F.lit(e.count()))
    return df.withColumn("slot", slot).join(e, "slot").drop("slot")


class History(Stage):
    """The history of the queries that ``asked`` keeps."""

    asked = staticmethod(lambda queries: queries)

    def __init__(self, spark, sf):
        self.base = Prepared.of(spark, sf)
        self.queries = self.asked(self.base.queries)
        self.text_vectors = hashed_vectors(spark, sf, D.history_texts(self.hist).withColumnRenamed("search_query", "text"), "text")
        self.query_vectors = hashed_vectors(spark, sf, self.queries, "search_query")
        self.nb = checkpointed(H.neighbour_texts(self.query_vectors, self.text_vectors, NEIGHBOURS))
        self.p_mc = H.microcat_given_text(self.hist)
        self.text_items = H.text_items(self.hist, self.corpus)


class JudgedHistory(History):
    """The same of the queries whose relevant items are known: no other counts in a metric or in training."""

    asked = staticmethod(lambda queries: queries.where("rel is not null"))


def hist_sql(*more: str) -> str:
    return prep("").rstrip() + "".join(f", {m}" for m in more)


@query("j1_microcat_given_text", hist_sql(PMC) + " select text, mc, round(p, 9) as p from pmc", HISTORY)
def j1(spark, sf):
    return H.microcat_given_text(Prepared.of(spark, sf).hist).withColumn("p", F.round("p", 9))


@query("j2_text_items", hist_sql(TI) + " select * from ti", HISTORY)
def j2(spark, sf):
    p = Prepared.of(spark, sf)
    return H.text_items(p.hist, p.corpus)


@query("j3_neighbour_texts", hist_sql(TEXTVEC) + " select qid, text, sim from nb", HISTORY)
def j3(spark, sf):
    return History.of(spark, sf).nb


@query("j4_microcat_mix", hist_sql(TEXTVEC, PMC, MIX) + " select qid, mc, round(p, 6) as p from mix", HISTORY)
def j4(spark, sf):
    h = History.of(spark, sf)
    return H.microcat_mix(h.nb, h.p_mc).withColumn("p", F.round("p", 6))


@query("j5_history_scores", hist_sql(TEXTVEC, TI, HS) + " select qid, row_id, round(hist_knn, 8) as hist_knn from hs", HISTORY)
def j5(spark, sf):
    h = History.of(spark, sf)
    return H.history_scores(h.nb, h.text_items, h.queries, h.corpus, NEAR).select("qid", "row_id", F.round("hist_knn", 8).alias("hist_knn"))


@query("j6_history_exact", hist_sql(TEXTVEC, TI, HS) + " select qid, row_id, hist_exact, hist_exact_same from hs where hist_exact > 0", HISTORY)
def j6(spark, sf):
    h = History.of(spark, sf)
    return H.history_exact(h.nb, h.text_items, h.queries, h.corpus, NEAR).select("qid", "row_id", "hist_exact", "hist_exact_same")


@query("j7_history_topk", hist_sql(TEXTVEC, TI, HS) + " select qid, row_id, rank from (select *, row_number() over (partition by qid order by round(hist_knn, 8) desc, row_id) as rank from hs) where rank <= 50", HISTORY)
def j7(spark, sf):
    h = History.of(spark, sf)
    return H.history_topk(H.history_scores(h.nb, h.text_items, h.queries, h.corpus, NEAR), 50).select("qid", "row_id", F.col("rank").cast("long").alias("rank"))


@query("j8_microcat_affinity", hist_sql(TEXTVEC, PMC, MIX, TI, HS) + " select qid, row_id, round(coalesce(p, 0), 6) as mc_aff from hs join (select row_id, item_microcat_id as mc from corpus) using (row_id) left join mix using (qid, mc)", HISTORY)
def j8(spark, sf):
    h = History.of(spark, sf)
    return H.history_affinity(h.nb, h.text_items, h.queries, h.corpus, H.microcat_mix(h.nb, h.p_mc), NEAR).withColumn("mc_aff", F.round("mc_aff", 6))


@query("j9_query_history_features", hist_sql(TEXTVEC) + " select qid, case when search_query in (select text from htx) then 1.0 else 0.0 end::double as q_seen, m as q_nn_sim from allq left join (select qid, max(sim) as m from nb group by qid) using (qid)", HISTORY)
def j9(spark, sf):
    h = History.of(spark, sf)
    return H.query_history_features(h.queries, h.hist, h.nb)


# --- F: vectors ---


@query("f1_encode")
def f1(spark, sf):
    return D.encode(table(spark, sf, "documents"), "doc_id", "text", max_chars=None)


@query(
    "f2_mean_pool",
    """with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from e group by all),
    n as (select label, sqrt(sum(x * x)) as n from m group by label) select label, list(round(x / greatest(n, 1e-6), 4) order by i) as vec from m join n using (label) group by label""",
)
def f2(spark, sf):
    labelled = table(spark, sf, "embeddings").where("label is not null")
    pooled = D.mean_pool(labelled.withColumnRenamed("embedding", "vec"), "label")
    return pooled.select("label", F.transform(D.l2_normalize(F.col("vec")), lambda x: N.rounded(x, 4)).alias("vec"))


VEC = ["vec_items_v", "vec_queries_v"]
VTR = "tr as (select loc as s, (loc * 3 + vec_id) % 10 as l, count(*) as c from (select vec_id, cast(label as int) as loc from embeddings where label % 4 <> 0) group by all), tot as (select s, sum(c) as total from tr group by s)"


NEAREST = f"near as materialized (select qid, row_id from (select qid, row_id, row_number() over (partition by qid order by round({DOT.format(a='q.vec', b='i.vec')}, 6) desc, row_id) as rank from vec_queries_v q cross join vec_items_v i) where rank <= 10)"


def _vec_pairs(spark, sf):
    """The pairs that the nearest items of every query make."""
    q, i = view(spark, sf, "vec_queries_v"), view(spark, sf, "vec_items_v")
    return q, i, D.block_topk(q, i, 10).select("qid", "row_id")


@query("f3_ensemble_sim", f"with {NEAREST}, p as (select q.qid, i.row_id, {DOT.format(a='q.vec', b='i.vec')} as a, list_sum(list_transform(list_zip(list_reverse(q.vec), i.vec), lambda z: z[1]::double * z[2]::double)) as b from near join vec_queries_v q using (qid) join vec_items_v i using (row_id)) select qid, row_id, round((round(a, 6) + round(b, 6)) / 2, 9) as sim from p", VEC)
def f3(spark, sf):
    q, i, pairs = _vec_pairs(spark, sf)
    both = D.score_pairs(pairs, q, i).unionByName(D.score_pairs(pairs, q.withColumn("vec", F.reverse("vec")), i))
    return D.ensemble_sim(both, ["qid", "row_id"]).withColumn("sim", F.round("sim", 9))


@query("f4_dense_topk", f"with s as (select qid, row_id, round({DOT.format(a='q.vec', b='i.vec')}, 6) as sim from vec_queries_v q cross join vec_items_v i) select qid, row_id, sim, rank from (select *, row_number() over (partition by qid order by sim desc, row_id) as rank from s) where rank <= 10", VEC)
def f4(spark, sf):
    got = D.block_topk(view(spark, sf, "vec_queries_v"), view(spark, sf, "vec_items_v"), 10)
    return got.select("qid", "row_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(
    "f5_dense_topk_loc",
    f"""with {VTR}, s as (select qid, row_id, round({DOT.format(a='q.vec', b='i.vec')} + 0.03::double * ({LP.format(s='q.loc', l='i.loc')}), 6) as score from vec_queries_v q cross join vec_items_v i left join tot on tot.s = q.loc left join tr on tr.s = q.loc and tr.l = i.loc)
    select qid, row_id, score, rank from (select *, row_number() over (partition by qid order by score desc, row_id) as rank from s) where rank <= 10""",
    VEC,
)
def f5(spark, sf):
    e = table(spark, sf, "embeddings").where("label % 4 <> 0").select("vec_id", F.col("label").cast("int").alias("loc"))
    trans = e.groupBy(F.col("loc").alias("s"), F.expr("cast((loc * 3 + vec_id) % 10 as int)").alias("l")).agg(F.count("*").alias("c"))
    got = D.block_topk(D.query_priors(view(spark, sf, "vec_queries_v"), trans), view(spark, sf, "vec_items_v"), 10, weight=0.03)
    return got.select("qid", "row_id", "score", F.col("rank").cast("long").alias("rank"))


@query("f6_score_pairs", f"with {NEAREST} select q.qid, i.row_id, round({DOT.format(a='q.vec', b='i.vec')}, 6) as sim from near join vec_queries_v q using (qid) join vec_items_v i using (row_id)", VEC)
def f6(spark, sf):
    q, i, pairs = _vec_pairs(spark, sf)
    return D.score_pairs(pairs, q, i)


@query("f7_history_texts", prep("select distinct search_query from hist"), TRAIN)
def f7(spark, sf):
    return D.history_texts(Prepared.of(spark, sf).hist)
