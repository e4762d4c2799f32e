"""Queries of candidates, features, metrics, answers and checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import answer_checks as N
from ..operators import bm25 as B
from ..operators import candidates as C
from ..operators import chargram as G
from ..operators import competitors as K
from ..operators import dense as D
from ..operators import history as H
from ..operators import location as L
from ..operators import ranking as R
from ..sources import tables as S
from ..sources.stages import checkpointed, kept
from .registry import query, table, view
from .sampling_queries import COORD, EXC, FIRST_COPY, KV, PICK, PLACE, Competitors
from .search_queries import CEN, HISTORY, HS, LP, MIX, NEAR, PMC, TEXTVEC, TI, TRANS, VECTORS, History, JudgedHistory, Prepared, hashed_vectors, hist_sql
from .text_queries import COMB_SQL, POST_SQL, STATS_SQL, tok_sql, _vec_sql, grams_sql, q_sql, _folder

K_LOC, K_GLOBAL, K_HIST = 300, 50, 50
ANSWER, RESERVE, RESERVE_RANK = 50, 5, 100
MODELS = ["a", "b"]
#: Per model: shift of the query's slot, and the item's number before it is taken modulo the number of vectors.
SHIFT = {"a": 0, "b": 7}
ITEM_SLOT = {"a": "row_id", "b": "(row_id * 3 + 1)"}


def r8(c: str, digits: int = 8) -> str:
    """A rounded number without a negative zero."""
    return f"coalesce(nullif(round({c}, {digits}), 0), 0)"


class Search(History):
    """Everything up to the candidates; tables that several steps read are kept in the shared folder."""

    history = History

    def __init__(self, spark, sf):
        self.__dict__.update(self.history.of(spark, sf).__dict__)
        self.spark, self.sf, self.done = spark, sf, {}
        self.trans = checkpointed(L.transitions(self.hist))
        self.totals = checkpointed(L.location_totals(self.trans))
        self.listed = self._listed()
        texts = self.corpus.select("row_id", F.col("item_title_raw").alias("title"), F.col("item_infm_params_text").alias("params"), F.col("item_description_raw").alias("description"))
        self.postings = kept(B.bm25_postings(texts), "postings")
        self.q_text = self.queries.select("qid", F.col("search_query").alias("query"), F.col("search_infm_params_text").alias("filters"))
        self.terms = kept(B.query_terms(self.q_text, B.vocabulary(self.postings)), "terms")
        self.chosen = kept(H.items_of_texts(self.text_items), "chosen")

    def _listed(self):
        """The rows that may be listed: src_row is the row that a copy was made of, base that row or the row itself."""
        return self.corpus.withColumns({"src_row": F.lit(None).cast("long"), "base": F.col("row_id")})

    def vectors(self, model):
        q = hashed_vectors(self.spark, self.sf, self.queries.select("qid", "fold", "search_query", F.col("search_location_id").alias("loc")), "search_query", SHIFT[model])
        e = table(self.spark, self.sf, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vec"))
        i = self.corpus.select("row_id").withColumn("slot", F.expr(ITEM_SLOT[model]) % e.count()).join(e, "slot").drop("slot")
        return q, i

    def once(self, name, make):
        if name not in self.done:
            self.done[name] = kept(make(), name)
        return self.done[name]

    def lists(self):
        return self.once("lists", self._lists)

    def features(self):
        return self.once("features", self._features)

    def _lists(self):
        dense = []
        places = self.listed.select("row_id", "src_row", F.col("item_location_id").alias("loc"), "in_bench", "folds")
        for m in MODELS:
            q, i = self.vectors(m)
            i, members = D.classes(i, places, ["vec"], K_LOC)
            best = lambda k, weight: D.class_topk(q, i, members, k, ["vec"], weight, self.trans)  # noqa: B023, E731
            dense.append((best(K_LOC, C.BETA_DENSE), best(K_GLOBAL, 0.0)))
        words = C.bm25_block_lists(self.terms, self.postings, self.queries, places, self.trans, K_LOC, K_GLOBAL)
        history = H.history_lists(self.nb, self.chosen, self.queries, self.listed.select("row_id", "base", "in_bench", "folds"), K_HIST, NEAR)
        return C.source_lists(words, history, dense)

    def cands(self, lists):
        return C.label(C.union_candidates(lists), self.queries, self.listed)

    def query_table(self, lists):
        best = C.best_scores(lists, {1: "q_bm_max"} | {4 + 2 * k: f"q_dn_max_{m}" for k, m in enumerate(MODELS)} | {3 + 2 * k: f"dnl_max_{m}" for k, m in enumerate(MODELS)})
        seen = H.query_history_features(self.queries, self.hist, self.nb)
        return C.query_features(self.queries, self.terms.select("qid", "n_terms").distinct(), self.totals, L.items_per_location(self.corpus), seen, best)

    def _features(self):
        lists = self.lists()
        cands = checkpointed(self.cands(lists).join(self.listed.select("row_id", "base"), "row_id"))
        pairs = checkpointed(cands.select("qid", F.col("base").alias("row_id")).distinct())
        titles = self.corpus.select("row_id", "item_title_raw")
        gram = checkpointed(G.fit(titles, "row_id", "item_title_raw"))
        filters = B.query_terms(self.q_text, B.vocabulary(self.postings), False, B.FILTER_KEYS, "filters")
        words = B.pair_scores(pairs, self.terms, filters, self.postings)
        parts = [
            (words, {"bm_t": 0.0, "bm_p": 0.0, "bm_d": 0.0, "bm_comb": 0.0, "cov_t": 0.0, "cov_any": 0.0, "pcov": -1.0}),
            (H.pair_history(pairs, self.nb, self.chosen, self.queries, NEAR), {"hist_knn": 0.0, "hist_exact": 0.0, "hist_exact_same": 0.0}),
            (H.microcat_affinity(pairs, H.microcat_mix(self.nb, self.p_mc), self.corpus), {"mc_aff": 0.0}),
            (G.similarity(pairs, G.vectors(self.queries, gram, "qid", "search_query"), G.vectors(titles, gram, "row_id", "item_title_raw")), {"char_t": 0.0}),
        ]
        for m in MODELS:
            q, i = self.vectors(m)
            parts.append((D.score_pairs(pairs, q, i).withColumnRenamed("sim", f"dense_{m}"), {f"dense_{m}": 0.0}))
        return C.features(cands, parts, self.listed, self.query_table(lists), L.centroids(self.hist, self.items), self.trans, self.totals, MODELS)


class Judged(Search):
    """The same of the queries whose relevant items are known."""

    history = JudgedHistory


class Copies(Search):
    """The same with the simulated competitors among the rows that may be listed."""

    def _listed(self):
        made = Competitors.of(self.spark, self.sf).competitors()
        return checkpointed(K.extend_corpus(self.corpus, made, FIRST_COPY).withColumn("base", F.coalesce("src_row", "row_id")))


class JudgedCopies(Copies):
    history = JudgedHistory


def _over_corpus(sql: str) -> str:
    return sql.replace("doc_items_v", "cdoc").replace("doc_queries_v", "cq")


INDEX = f"""cdoc as (select row_id, item_title_raw as title, item_infm_params_text as params, item_description_raw as description from corpus), cq as (select qid, search_query as query, search_infm_params_text as filters from allq),
{_over_corpus(tok_sql(400, 600))}, {STATS_SQL.replace('doc_items_v', 'cdoc')}, {POST_SQL}, {_over_corpus(q_sql('query', 'qt', True))}, {COMB_SQL}"""
SEE = "(corpus.in_bench or coalesce(list_contains(corpus.folds, allq.fold), false))"
SLOT = "(('0x' || substr(md5({t}), 1, 12))::bigint + {k}) % " + VECTORS
DS = ", ".join(
    f"""q_{m} as materialized (select qid, embedding::double[] as vec from allq join embeddings on vec_id = {SLOT.format(t='search_query', k=SHIFT[m])}), i_{m} as materialized (select row_id, embedding::double[] as vec from corpus join embeddings on vec_id = {ITEM_SLOT[m]} % {VECTORS})"""
    for m in MODELS
)
SEEN = f"""{DS}, seen as materialized (select qid, row_id, search_location_id as s, item_location_id as l, {LP.format(s='search_location_id', l='item_location_id')} as lp from allq join corpus on {SEE} left join tot on tot.s = search_location_id left join tr on tr.s = search_location_id and tr.l = item_location_id),
sims as materialized (select qid, row_id, lp, {', '.join(f'round(list_dot_product(q_{m}.vec, i_{m}.vec), 6) as dense_{m}, round(list_dot_product(q_{m}.vec, i_{m}.vec) + 0.03::double * lp, 6) as loc_{m}' for m in MODELS)} from seen {' '.join(f'join q_{m} using (qid) join i_{m} using (row_id)' for m in MODELS)})"""
BMV = "bmv as materialized (select comb.*, lp from comb join seen using (qid, row_id))"


def _list_sql(bit: int, of: str, score: str, k: int, digits: int = 6) -> str:
    return f"select qid, row_id, {bit} as bit, rank, score from (select qid, row_id, {score} as score, row_number() over (partition by qid order by round({score}, {digits}) desc, row_id) as rank from {of}) where rank <= {k}"


LISTS = "lists as materialized (" + " union all ".join(
    [_list_sql(0, "bmv", "(bm_comb + 2.0::double * lp)", K_LOC), _list_sql(1, "bmv", "bm_comb", K_GLOBAL), _list_sql(2, "hs", "hist_knn", K_HIST, 8)]
    + [x for k, m in enumerate(MODELS) for x in (_list_sql(3 + 2 * k, "sims", f"loc_{m}", K_LOC), _list_sql(4 + 2 * k, "sims", f"dense_{m}", K_GLOBAL))]
) + ")"
CANDS = """cands as materialized (select qid, row_id, src, case when rel is not null and list_contains(rel, item_id) then 1 else 0 end as label
  from (select qid, row_id, bit_or(1::bigint << bit) as src from lists group by all) join allq using (qid) join corpus using (row_id))"""
ALL = [CEN, TRANS, TEXTVEC, PMC, MIX, TI, HS, INDEX, SEEN, BMV, LISTS, CANDS]
NREL = "nrel as (select qid, fold, len(rel) as n_rel from allq where rel is not null)"


def search_sql(*more: str) -> str:
    return hist_sql(*ALL, *more)


# --- L: candidates and features ---


@query("l1_source_lists", search_sql() + " select qid, row_id, bit, rank, round(score, 8) as score from lists", HISTORY)
def l1(spark, sf):
    return Search.of(spark, sf).lists().withColumn("score", F.round("score", 8))


@query("l2_union_candidates", search_sql() + " select qid, row_id, src from cands", HISTORY)
def l2(spark, sf):
    return C.union_candidates(Search.of(spark, sf).lists())


FLAGS = [f"src{k}" for k in range(3 + 2 * len(MODELS))]


@query("l3_source_flags", search_sql() + " select qid, row_id, src, " + ", ".join(f"((src >> {k}) & 1)::double as src{k}" for k in range(len(FLAGS))) + " from cands", HISTORY)
def l3(spark, sf):
    return C.source_flags(C.union_candidates(Search.of(spark, sf).lists()), len(FLAGS))


@query("l4_label", search_sql() + " select qid, row_id, src, label from cands", HISTORY)
def l4(spark, sf):
    s = Search.of(spark, sf)
    return s.cands(s.lists())


@query("l5_candidate_recall", search_sql() + " select fold, round(avg(coalesce(h, 0) / len(rel)), 6) as recall from allq left join (select qid, sum(label)::double as h from cands group by qid) using (qid) where rel is not null group by fold", HISTORY)
def l5(spark, sf):
    s = Judged.of(spark, sf)
    return C.candidate_recall(s.cands(s.lists()), s.queries).withColumn("recall", F.round("recall", 6))


BEST = "best as materialized (select qid, max(score) filter (bit = 1) as q_bm_max, " + ", ".join(f"max(score) filter (bit = {4 + 2 * k}) as q_dn_max_{m}, max(score) filter (bit = {3 + 2 * k}) as dnl_max_{m}" for k, m in enumerate(MODELS)) + " from lists where rank = 1 group by qid)"
REL = "rel_ as materialized (select qid, row_id, src, label, coalesce(bm_comb, 0) as bm_comb, coalesce(bm_comb, 0) / greatest(coalesce(q_bm_max, 0), 1e-6) as bm_rel, sims.lp, " + ", ".join(f"dense_{m}, q_dn_max_{m}, dense_{m} - q_dn_max_{m} as dense_rel_{m}, dense_{m} + 0.03::double * sims.lp - dnl_max_{m} as dense_loc_rel_{m}" for m in MODELS) + " from cands join sims using (qid, row_id) left join comb using (qid, row_id) left join best using (qid)),\nrelm as materialized (select *, (dense_loc_rel_a + dense_loc_rel_b) / 2 as dense_loc_rel_mean from rel_)"


@query("l7_relative_scores", search_sql(BEST, REL) + " select qid, row_id, " + f"{r8('bm_rel')} as bm_rel, {r8('dense_rel_a')} as dense_rel_a, {r8('dense_loc_rel_b')} as dense_loc_rel_b from relm", HISTORY)
def l7(spark, sf):
    return Search.of(spark, sf).features().select("qid", "row_id", F.round("bm_rel", 8).alias("bm_rel"), F.round("dense_rel_a", 8).alias("dense_rel_a"), F.round("dense_loc_rel_b", 8).alias("dense_loc_rel_b"))


@query("l10_mean_relative", search_sql(BEST, REL) + " select qid, row_id, " + f"{r8('dense_loc_rel_mean')} as dense_loc_rel_mean from relm", HISTORY)
def l10(spark, sf):
    return Search.of(spark, sf).features().select("qid", "row_id", F.round("dense_loc_rel_mean", 8).alias("dense_loc_rel_mean"))


QF = """qf as materialized (select qid, fold, search_location_id as s, coalesce(n_terms, 0)::double as q_nterms, length(search_query)::double as q_len, (length(search_infm_params_text) > 0)::int::double as q_has_params,
  case when search_query in (select text from htx) then 1.0 else 0.0 end::double as q_seen, q_nn_sim, coalesce(self_share, -1.0) as q_loc_self, ln(1 + coalesce(total, 0)::double) as q_loc_hist, ln(1 + coalesce(n_items, 0)::double) as q_loc_items, coalesce(q_bm_max, 0) as q_bm_max
  from allq left join (select distinct qid, n_terms from qt) using (qid) left join (select qid, max(sim) as q_nn_sim from nb group by qid) using (qid) left join tot on tot.s = search_location_id
  left join (select item_location_id, count(*) as n_items from corpus where in_bench group by 1) il on il.item_location_id = search_location_id left join best using (qid))"""
QCOLS = ["q_nterms", "q_len", "q_has_params", "q_seen", "q_nn_sim", "q_loc_self", "q_loc_hist", "q_loc_items", "q_bm_max"]


@query("l8_query_features", search_sql(BEST, QF) + " select qid, fold, " + ", ".join(f"round({c}, 5) as {c}" for c in QCOLS) + " from qf", HISTORY)
def l8(spark, sf):
    s = Search.of(spark, sf)
    return s.query_table(s.lists()).select("qid", "fold", *[F.round(c, 5).alias(c) for c in QCOLS])


def _rank_sql(name: str, score: str) -> str:
    return f"row_number() over (partition by qid order by round({score}, 8) desc, row_id) - 1 as {name}"


CHAR = f"""g as materialized (select row_id, gram, count(*) as tf from ({grams_sql('corpus', 'row_id', 'item_title_raw')}) group by all),
model as (select gram, count(*) as df, ln((1::double + (select count(*) from corpus)) / (1::double + count(*))) + 1::double as idf from g group by gram having count(*) >= 2),
{_vec_sql('cv', 'g', 'row_id')}, qg as (select qid, gram, count(*) as tf from ({grams_sql('allq', 'qid', 'search_query')}) group by all), {_vec_sql('cqv', 'qg', 'qid')},
chars as materialized (select qid, row_id, sum(cqv.w * cv.w) as char_t from cands join cqv using (qid) join cv using (row_id, gram) group by all)"""
FEATURES = (
    "feats as materialized (select qid, relm.row_id, qf.fold, label, src, bm_comb, bm_rel, lp, dense_a, dense_b, dense_rel_a, dense_loc_rel_a, dense_loc_rel_mean, coalesce(char_t, 0) as char_t, (qf.s = item_location_id)::int::double as same_loc, "
    "ln(1 + coalesce(2 * 6371.0::double * asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians(item_latitude - cen.lat) / 2), 2) + cos(radians(cen.lat)) * cos(radians(item_latitude)) * pow(sin(radians(item_longitude - cen.lon) / 2), 2))))), 5000.0)) as dist, "
    "coalesce(hist_knn, 0) as hist_knn, coalesce(hist_exact, 0) as hist_exact, coalesce(mix.p, 0) as mc_aff, ln(1 + greatest(0, least(coalesce(item_price, 0)::double, 1e9))) as i_price, q_nterms, q_loc_self, q_bm_max, item_category_id as category, "
    + ", ".join([_rank_sql("rk_bm_comb", "bm_comb"), _rank_sql("rk_hist_knn", "coalesce(hist_knn, 0)"), _rank_sql("rk_dense_a", "dense_a"), _rank_sql("rk_dense_loc_b", "(dense_b + 0.03::double * lp)"), _rank_sql("rk_dense_loc_mean", "dense_loc_rel_mean"), _rank_sql("rk_bm_loc", "(bm_comb + 2.0::double * lp)")])
    + " from relm join qf using (qid) join corpus using (row_id) left join cen on cen.loc = qf.s left join hs using (qid, row_id) left join mix on mix.qid = relm.qid and mix.mc = item_microcat_id left join chars using (qid, row_id))"
).replace("select qid, relm.row_id", "select relm.qid, relm.row_id").replace("partition by qid", "partition by relm.qid").replace(", row_id) - 1", ", relm.row_id) - 1")
FULL = (BEST, REL, QF, CHAR, FEATURES)
SHOWN = ["bm_comb", "bm_rel", "lp", "dense_a", "dense_rel_a", "dense_loc_rel_a", "char_t", "same_loc", "dist", "hist_knn", "hist_exact", "mc_aff", "i_price", "q_nterms", "q_loc_self", "q_bm_max"]
RANKS = ["rk_bm_comb", "rk_hist_knn", "rk_dense_a", "rk_dense_loc_b", "rk_dense_loc_mean", "rk_bm_loc"]


@query("l6_features", search_sql(*FULL) + " select qid, row_id, fold, label, " + ", ".join(f"{r8(c)} as {c}" for c in SHOWN) + " from feats", HISTORY)
def l6(spark, sf):
    return Search.of(spark, sf).features().select("qid", "row_id", "fold", "label", *[F.round(c, 8).alias(c) for c in SHOWN])


@query("l9_rank_within", search_sql(*FULL) + f" select qid, row_id, {', '.join(RANKS)} from feats", HISTORY)
def l9(spark, sf):
    return Search.of(spark, sf).features().select("qid", "row_id", *RANKS)


# --- L over the corpus with the simulated competitors: scores are those of the original, places the copy's own ---
EXT = f"""ext as materialized (select row_id, null::bigint as src_row, row_id as base, * exclude (row_id) from corpus union all by name
  select {FIRST_COPY} + row_number() over (order by fold, qid, src_row) - 1 as row_id, src_row, src_row as base, c.* exclude (row_id, item_location_id, item_latitude, item_longitude, folds, in_bench),
         loc as item_location_id, lat as item_latitude, lon as item_longitude, [fold::bigint] as folds, false as in_bench from comp join corpus c on c.row_id = src_row),
xseen as materialized (select qid, row_id, base, {LP.format(s='search_location_id', l='item_location_id')} as lp from allq join ext on (ext.in_bench or coalesce(list_contains(ext.folds, allq.fold), false)) left join tot on tot.s = search_location_id left join tr on tr.s = search_location_id and tr.l = item_location_id),
xsims as materialized (select xseen.qid, xseen.row_id, lp, {', '.join(f'round(list_dot_product(q_{m}.vec, i_{m}.vec), 6) as dense_{m}, round(list_dot_product(q_{m}.vec, i_{m}.vec) + 0.03::double * lp, 6) as loc_{m}' for m in MODELS)} from xseen {' '.join(f'join q_{m} on q_{m}.qid = xseen.qid join i_{m} on i_{m}.row_id = base' for m in MODELS)}),
xcomb as materialized (select xseen.qid, xseen.row_id, bm_t, bm_p, bm_d, bm_comb, lp from comb join xseen on xseen.qid = comb.qid and base = comb.row_id), xbmv as (select * from xcomb),
xhs as materialized (select xseen.qid, xseen.row_id, hist_knn, hist_exact, hist_exact_same from hs join xseen on xseen.qid = hs.qid and base = hs.row_id)"""


def _extended(sql: str) -> str:
    """The same tables over the extended corpus, under names of their own."""
    named = re.sub(r"\b(lists|cands|sims|best|rel_|relm|feats|chars|bmv|comb|hs|qf|sc)\b", r"x\1", sql)
    return re.sub(r"\bcorpus\b", "ext", named).replace("case when rel is not null", "case when src_row is null and rel is not null")


XCHAR = CHAR.replace("from cands join cqv using (qid) join cv using (row_id, gram) group by all", "from xcands join (select row_id, base from ext) e using (row_id) join cqv using (qid) join cv on cv.row_id = base and cv.gram = cqv.gram group by all").replace("select qid, row_id, sum(cqv.w * cv.w)", "select qid, xcands.row_id, sum(cqv.w * cv.w)").replace("chars as", "xchars as")


def copies_sql(*more: str) -> str:
    return hist_sql(*ALL[:-2], KV, EXC, PICK, PLACE, COORD, EXT, _extended(LISTS), _extended(CANDS), *more)


@query("l1_source_lists_with_copies", copies_sql() + " select qid, row_id, bit, rank, round(score, 8) as score from xlists", HISTORY)
def l1_copies(spark, sf):
    return Copies.of(spark, sf).lists().withColumn("score", F.round("score", 8))


@query("l4_label_with_copies", copies_sql() + " select qid, row_id, src, label from xcands", HISTORY)
def l4_copies(spark, sf):
    s = Copies.of(spark, sf)
    return s.cands(s.lists())


@query("l5_candidate_recall_with_copies", copies_sql() + " select fold, round(avg(coalesce(h, 0) / len(rel)), 6) as recall from allq left join (select qid, sum(label)::double as h from xcands group by qid) using (qid) where rel is not null group by fold", HISTORY)
def l5_copies(spark, sf):
    s = JudgedCopies.of(spark, sf)
    return C.candidate_recall(s.cands(s.lists()), s.queries).withColumn("recall", F.round("recall", 6))


XFULL = (_extended(BEST), _extended(REL), _extended(QF), XCHAR, _extended(FEATURES))


@query("l6_features_with_copies", copies_sql(*XFULL) + " select qid, row_id, fold, label, " + ", ".join(f"{r8(c)} as {c}" for c in SHOWN) + " from xfeats", HISTORY)
def l6_copies(spark, sf):
    return Copies.of(spark, sf).features().select("qid", "row_id", "fold", "label", *[F.round(c, 8).alias(c) for c in SHOWN])


# --- M: ranking, metrics, answer ---
# SQL can repeat a fixed score over the features, so that all but the trained queries rank by this one.
M_RANKS = RANKS
PARTS = {1: "bm_rel", 2: "dense_loc_rel_mean", 3: "hist_knn"}
SCORED = f"sc as materialized (select *, round({' + '.join(r8(c) for c in PARTS.values())}, 6) as score from feats)"
RANKED = [*FULL, SCORED, NREL]


class Ranked(Search):
    """The features of all candidates with a score."""

    search = Search

    def __init__(self, spark, sf):
        search = self.search.of(spark, sf)
        self.__dict__.update(search.__dict__)
        category = self.listed.select("row_id", F.col("item_category_id").alias("category"))
        score = F.round(sum((F.round(c, 8) for c in PARTS.values()), F.lit(0.0)), 6)
        self.scored = checkpointed(search.features().drop("category").join(category, "row_id").withColumn("score", score))
        self.n_rel = R.n_relevant(self.queries)


class RankedJudged(Ranked):
    """The same of the queries whose relevant items are known: metrics, folds and training read no others."""

    search = Judged


def ranked_sql(*more: str) -> str:
    return search_sql(*RANKED, *more)


def _recall_sql(rank: str, k: int) -> str:
    return f"select fold, round(avg(coalesce(h, 0) / n_rel), 6) as recall from nrel left join (select qid, sum(label)::double as h from (select *, {rank} as r_ from sc) where r_ <= {k} group by qid) using (qid) group by fold"


BY_SCORE = "row_number() over (partition by qid order by score desc, row_id)"


@query("m1_drop_useless", ranked_sql() + " select qid, row_id, label from sc where qid in (select qid from sc where label = 1)", HISTORY)
def m1(spark, sf):
    return R.drop_useless(RankedJudged.of(spark, sf).scored).select("qid", "row_id", "label")


@query("m2_recall_at", ranked_sql() + " " + _recall_sql(BY_SCORE, ANSWER), HISTORY)
def m2(spark, sf):
    r = RankedJudged.of(spark, sf)
    return R.recall_at(r.scored, "score", r.n_rel, ANSWER).withColumn("recall", F.round("recall", 6))


class RankedCopies(Ranked):
    """The same over the corpus with the simulated competitors."""

    search = JudgedCopies


@query("m2_recall_with_copies", copies_sql(*XFULL, _extended(SCORED), NREL) + " " + _recall_sql(BY_SCORE, ANSWER).replace("from sc)", "from xsc)"), HISTORY)
def m2_copies(spark, sf):
    r = RankedCopies.of(spark, sf)
    return R.recall_at(r.scored, "score", r.n_rel, ANSWER).withColumn("recall", F.round("recall", 6))


@query("m3_single_source_recall", ranked_sql() + " " + " union all ".join(f"select '{c}' as source, round(avg(coalesce(h, 0) / n_rel), 6) as recall from nrel left join (select qid, sum(label)::double as h from sc where {c} < {ANSWER} group by qid) using (qid)" for c in M_RANKS), HISTORY)
def m3(spark, sf):
    r = RankedJudged.of(spark, sf)
    return R.single_source_recall(r.scored, list(M_RANKS), r.n_rel, ANSWER).withColumn("recall", F.round("recall", 6))


@query("m4_fold_split", ranked_sql() + " select qid, row_id, fold, case when fold = 0 then 'evaluate' when fold = 6 then 'stop' else 'train' end as part from sc where fold >= 0", HISTORY)
def m4(spark, sf):
    return R.fold_split(RankedJudged.of(spark, sf).scored, 0).select("qid", "row_id", "fold", "part")


#: Columns of the scored candidates that are no features; category only decides about reserved places.
NO_FEATURES = ("qid", "row_id", "fold", "label", "src", "category", "score")
#: Trees at most, as in the reference setting, and trees without a better nDCG@50 after which no more are added.
ROUNDS, PATIENCE, FIRST_ROUNDS = 3000, 15, 40
#: Folds with a model of their own in the report; the final fit takes the mean of their best numbers of trees.
REPORTED = (0, 1)


def _tree_features(r):
    return [c for c in r.scored.columns if c not in NO_FEATURES]


def _trained(spark, sf, fold=0):
    """The model that is reported for a fold, fitted once a session, and the rows by part."""
    r = RankedJudged.of(spark, sf)
    parts, features = R.fold_split(r.scored, fold), _tree_features(r)
    if ("model", fold) not in r.done:
        fit, stop = (R.drop_useless(parts.where(F.col("part") == p)).select("qid", "row_id", "label", *features) for p in ("train", "stop"))
        r.done["model", fold], r.done["curve", fold] = R.stopped_ranker(kept(fit, "fit"), kept(stop, "stop"), features, most=ROUNDS, patience=PATIENCE, first=FIRST_ROUNDS)
    return r.done["model", fold], parts


@query("m5_train_ranker")
def m5(spark, sf):
    model, parts = _trained(spark, sf)
    return R.predict(model, parts.where("part = 'evaluate'")).select("qid", "row_id", "label", "pred")


@query("m5_fold_report")
def m5_report(spark, sf):
    """Recall and number of trees of the trained models, each over the fold that it did not see."""
    r, out = RankedJudged.of(spark, sf), None
    for fold in REPORTED:
        model, parts = _trained(spark, sf, fold)
        judged = R.predict(model, parts.where("part = 'evaluate'"))
        one = R.recall_at(judged, "pred", r.n_rel.where(F.col("fold") == fold), ANSWER).withColumn("iterations", F.lit(float(R.n_trees(model))))
        out = one if out is None else out.unionByName(one)
    return out


@query("m5_stopping_curve")
def m5_curve(spark, sf):
    """nDCG@50 on the stopping fold after each tree that was tried, and whether the tree was kept."""
    model = _trained(spark, sf)[0]
    curve = RankedJudged.of(spark, sf).done["curve", 0]
    return spark.createDataFrame([(k + 1, float(v), k < R.n_trees(model)) for k, v in enumerate(curve)], "tree int, ndcg double, kept boolean")


@query("m12_trained_report")
def m12_trained(spark, sf):
    """Mean recall over the reported folds, each judged by the model that did not see it, and the mean best number of trees."""
    return R.report(m5_report(spark, sf))


@query("m5_final_answer")
def m5_final(spark, sf):
    """The answer by three seeds fitted to all folds, with 1.1 times the mean best number of trees, their ranks added."""
    r = Ranked.of(spark, sf)
    trees = int(1.1 * sum(R.n_trees(_trained(spark, sf, f)[0]) for f in REPORTED) / len(REPORTED))
    features = _tree_features(r)
    train = kept(R.drop_useless(RankedJudged.of(spark, sf).scored.where("fold >= 0")).select("qid", "row_id", "label", *features), "fit")
    preds = R.final_predictions(train, r.scored.where("fold = -1"), features, max(1, trees))
    ranked = r.scored.drop("score").join(R.rank_ensemble(preds), ["qid", "row_id"])
    return R.answer(R.reserve_slots(ranked, r.queries, ANSWER, RESERVE, RESERVE_RANK), r.queries, r.corpus, ANSWER)


@query("m6_feature_importance")
def m6(spark, sf):
    return R.feature_importance(spark, _trained(spark, sf)[0], _tree_features(RankedJudged.of(spark, sf)))


def _preds(r):
    """The predictions of three rankers, each by one feature; equal ones share their ranks."""
    each = F.array(*[F.struct(F.lit(k).alias("seed"), (F.round(c, 8) + F.lit(0.0)).alias("pred")) for k, c in PARTS.items()])
    return r.scored.select("qid", "row_id", F.explode(each).alias("p")).select("qid", "row_id", "p.*")


PREDS = "preds as materialized (" + " union all ".join(f"select qid, row_id, {k} as seed, {r8(c)} as pred from sc" for k, c in PARTS.items()) + ")"


@query(
    "m7_rank_ensemble",
    ranked_sql(PREDS) + """, r as (select qid, row_id, (rank() over (partition by seed, qid order by pred) + (count(*) over (partition by seed, qid, pred) - 1) / 2.0::double) / count(*) over (partition by seed, qid) as r from preds)
    select qid, row_id, round(sum(r), 6) as score from r group by qid, row_id""",
    HISTORY,
)
def m7(spark, sf):
    return R.rank_ensemble(_preds(Ranked.of(spark, sf))).withColumn("score", F.round("score", 6))


@query("m8_top_items", ranked_sql() + f" select qid, row_id, rank from (select qid, row_id, {BY_SCORE} as rank from sc) where rank <= {ANSWER}", HISTORY)
def m8(spark, sf):
    return R.top_items(Ranked.of(spark, sf).scored, ANSWER).select("qid", "row_id", F.col("rank").cast("long").alias("rank"))


RESERVED = f"""top as materialized (select qid, row_id, rank from (select qid, row_id, {BY_SCORE} as rank from sc) where rank <= {ANSWER}),
goods as (select * from (select qid, row_id, row_number() over (partition by qid order by rk_dense_loc_mean, row_id) as g from sc join (select qid from allq where fold = -1 and search_category = 0) using (qid) where category <> 114 and rk_dense_loc_mean < {RESERVE_RANK}) where g <= {RESERVE}),
fresh as (select qid, row_id, row_number() over (partition by qid order by g) as place from goods where (qid, row_id) not in (select (qid, row_id) from top)),
kept as (select top.* from top left join (select qid, count(*) as extra from fresh group by qid) using (qid) where rank <= {ANSWER} - coalesce(extra, 0)),
ranked as materialized (select qid, row_id, rank, false as forced from kept union all select f.qid, f.row_id, coalesce(k, 0) + place, true from fresh f left join (select qid, count(*) as k from kept group by qid) using (qid)),
ansrows as (select qid, item_id, row_number() over (partition by qid order by rank, item_id) as rn from (select qid, item_id, min(rank) as rank from ranked join corpus using (row_id) where in_bench group by all)),
ans as materialized (select qid as query_id, coalesce(answer, '') as answer from allq left join (select qid, string_agg(item_id, ' ' order by rn) as answer from ansrows where rn <= {ANSWER} group by qid) using (qid) where fold = -1)"""


def _reserved(r):
    return R.reserve_slots(r.scored, r.queries, ANSWER, RESERVE, RESERVE_RANK)


def _answer(spark, sf):
    r = Ranked.of(spark, sf)
    ranked = checkpointed(_reserved(r))
    return r, ranked, R.answer(ranked, r.queries, r.corpus, ANSWER)


@query("m9_reserve_slots", ranked_sql(RESERVED) + " select * from ranked", HISTORY)
def m9(spark, sf):
    return _reserved(Ranked.of(spark, sf))


@query("m10_answer", ranked_sql(RESERVED) + " select * from ans", HISTORY)
def m10(spark, sf):
    return _answer(spark, sf)[2]


SIZES = "case when answer = '' then 0 else len(string_split(answer, ' ')) end"


@query("m11_answer_stats", ranked_sql(RESERVED) + f" select count(*) as rows, min({SIZES})::bigint as min_items, round(avg({SIZES}), 6) as mean_items, (select count(*) filter (forced) from ranked) as forced from ans", HISTORY)
def m11(spark, sf):
    _, ranked, ans = _answer(spark, sf)
    return R.answer_stats(ans, ranked).withColumn("mean_items", F.round("mean_items", 6))


@query("m12_report", ranked_sql() + f" select round(avg(recall), 5) as mean_recall, avg(queries::double) as mean_iterations, count(*) as folds from ({_recall_sql(BY_SCORE, ANSWER)}) join (select fold, count(*) as queries from nrel group by fold) using (fold) where fold in (0, 1)", HISTORY)
def m12(spark, sf):
    r = RankedJudged.of(spark, sf)
    per_fold = R.recall_at(r.scored, "score", r.n_rel, ANSWER).where("fold in (0, 1)").withColumn("recall", F.round("recall", 6)).join(r.n_rel.groupBy("fold").agg(F.count("*").alias("queries")), "fold").withColumn("iterations", F.col("queries").cast("double"))
    return R.report(per_fold).withColumn("mean_recall", F.round("mean_recall", 5))


@query(
    "m13_ndcg_at",
    ranked_sql() + f", d as (select qid, sum(case when rn <= {ANSWER} and label = 1 then 1.0::double / log2(rn + 1) else 0 end) as dcg, sum(label)::int as n from (select *, {BY_SCORE} as rn from sc) group by qid) select qid, round(dcg / list_sum(list_transform(range(1, least(n, {ANSWER}) + 1), lambda i: 1.0::double / log2(i + 1))), 6) as ndcg from d where n > 0",
    HISTORY,
)
def m13(spark, sf):
    return R.ndcg_at(RankedJudged.of(spark, sf).scored, "score", ANSWER).withColumn("ndcg", F.round("ndcg", 6))


# A plain answer for the sink and the checks: the first items of the query's own location.
PLAIN = f"""ans as materialized (select query_id, coalesce(answer, '') as answer from bench_queries_v left join (select query_id, string_agg(item_id, ' ' order by row_id) as answer
  from (select query_id, item_id, row_id, row_number() over (partition by query_id order by row_id) as rn from bench_queries_v join bench_items_v on item_location_id = search_location_id) where rn <= {ANSWER} group by query_id) using (query_id))"""
BENCH = ["bench_items_v", "bench_queries_v"]


def _first_items(items):
    """The first items of each location, the same for all of its queries: a query meets no more than it may answer."""
    w = Window.partitionBy("item_location_id").orderBy("row_id")
    return items.select("item_location_id", "row_id", F.row_number().over(w).alias("rn")).where(F.col("rn") <= ANSWER).drop("rn")


def _plain(spark, sf):
    items, q = view(spark, sf, "bench_items_v"), view(spark, sf, "bench_queries_v")
    queries = q.select(F.col("query_id").alias("qid"), F.lit(-1).alias("fold"), "search_location_id")
    pairs = _first_items(items).join(queries, F.col("item_location_id") == F.col("search_location_id")).select("qid", "row_id", (-F.col("row_id")).cast("double").alias("score"))
    return items, q, R.answer(R.top_items(pairs, ANSWER), queries, items.withColumn("in_bench", F.lit(True)), ANSWER)


@query("a5_write_answer", f"with {PLAIN} select * from ans", BENCH)
def a5(spark, sf):
    path = _folder(spark, "answer")
    S.write_answer(_plain(spark, sf)[2], path)
    return S.read_answer(spark, path)


@query("a7_report_json", ranked_sql() + " select concat('{\"fold\":', fold, ',\"queries\":', count(*), '}') as json from nrel group by fold", HISTORY)
def a7(spark, sf):
    return S.report_rows(R.n_relevant(Prepared.of(spark, sf).queries).groupBy("fold").agg(F.count("*").alias("queries")))


# --- N: checks of the answer ---


# The answer with one fault of each kind planted.
FAULTS = """bad as materialized (select query_id, case when query_id = (select min(query_id) from ans) then concat(answer, ' ', split_part(answer, ' ', 1)) when query_id = (select max(query_id) from ans) then 'NOT_AN_ITEM ffffffffffffffff' else answer end as answer from ans
  union all select 'short', '' union all select min(query_id), '' from ans where answer <> '')"""


def _faulty(spark, sf):
    items, queries, ans = _plain(spark, sf)
    ans = checkpointed(ans)
    ends = ans.agg(F.min("query_id").alias("lo"), F.max("query_id").alias("hi"))
    first = F.element_at(F.split("answer", " "), 1)
    bad = ans.join(F.broadcast(ends)).select("query_id", F.when(F.col("query_id") == F.col("lo"), F.concat("answer", F.lit(" "), first)).when(F.col("query_id") == F.col("hi"), "NOT_AN_ITEM ffffffffffffffff").otherwise(F.col("answer")).alias("answer"))
    more = spark.range(1).select(F.lit("short").alias("query_id"), F.lit("").alias("answer")).unionByName(ans.where("answer <> ''").agg(F.min("query_id").alias("query_id")).withColumn("answer", F.lit("")))
    return items, queries, checkpointed(bad.unionByName(more))


def faulty_sql(body: str) -> str:
    return f"with {PLAIN}, {FAULTS} {body}"


IDS = "(select query_id, unnest(string_split(answer, ' ')) as item_id from bad where answer <> '')"


@query("n1_header", faulty_sql("select 'header' as \"check\", count(*) as n_bad from bad"), BENCH)
def n1(spark, sf):
    path = _folder(spark, "answer")
    _faulty(spark, sf)[2].withColumnRenamed("query_id", "query").write.option("header", True).csv(path)
    return N.header(spark.read.csv(path, header=True))


@query("n2_query_ids", faulty_sql("select 'repeated_query' as \"check\", count(*) as n_bad from (select query_id from bad group by 1 having count(*) > 1) union all select 'query_id_length', count(*) from bad where length(query_id) <> 16"), BENCH)
def n2(spark, sf):
    return N.query_ids(_faulty(spark, sf)[2])


@query("n3_query_set", faulty_sql("select 'missing_query' as \"check\", count(*) as n_bad from bench_queries_v where query_id not in (select query_id from bad) union all select 'unknown_query', count(*) from (select distinct query_id from bad) where query_id not in (select query_id from bench_queries_v)"), BENCH)
def n3(spark, sf):
    _, queries, bad = _faulty(spark, sf)
    return N.query_set(bad, queries)


@query("n4_row_size", faulty_sql(f"select 'too_many_items' as \"check\", count(*) as n_bad from bad where len(string_split(answer, ' ')) > {ANSWER}"), BENCH)
def n4(spark, sf):
    return N.row_size(_faulty(spark, sf)[2], ANSWER)


@query("n5_repeated_items", faulty_sql("select 'repeated_item' as \"check\", count(*) as n_bad from bad where len(list_distinct(string_split(answer, ' '))) < len(string_split(answer, ' '))"), BENCH)
def n5(spark, sf):
    return N.repeated_items(_faulty(spark, sf)[2])


@query("n6_item_format", faulty_sql(f"select 'item_id_format' as \"check\", count(*) as n_bad from {IDS} where not regexp_matches(item_id, '^[0-9a-f]{{16}}$')"), BENCH)
def n6(spark, sf):
    return N.item_format(_faulty(spark, sf)[2])


@query("n7_known_items", faulty_sql(f"select 'unknown_item' as \"check\", count(*) as n_bad from {IDS} where item_id not in (select item_id from bench_items_v)"), BENCH)
def n7(spark, sf):
    items, _, bad = _faulty(spark, sf)
    return N.known_items(bad, items)


@query("n8_sizes", faulty_sql(f"select count(*) as rows, min({SIZES})::bigint as min_items, max({SIZES})::bigint as max_items from bad"), BENCH)
def n8(spark, sf):
    return N.sizes(_faulty(spark, sf)[2])
