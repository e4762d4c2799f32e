"""Vector search by blocked matrix products, and small operations on vector columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.stages import kept

#: Vectors of one side of a block product, and how many such blocks of items one task goes through one after another.
BLOCK = 4096
RUN = 16
#: Queries of a block that are scored at once, and pairs that are gathered at once.
ASKED = 512
GATHERED = 1 << 16
DIGITS = 6


def hashed_ngram_encoder(dim: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a trained encoder: counts of n-grams hashed by the CRC-32 of their UTF-8, at unit length.

    The n-grams of a batch are hashed together, a byte at a time; a text of fewer than n characters is one n-gram.
    """
    import zlib

    # What a low byte of the state turns into; CRC-32 is linear but for its inversions, which cancel out here.
    after = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)

    def encode_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        if not texts:
            return out
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        starts = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # of the characters, by byte
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        grams = np.maximum(sizes - n + 1, 1)
        of = np.repeat(np.arange(len(texts)), grams)
        first = np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(ends - sizes, grams)
        at, stop = starts[first], starts[np.minimum(first + n, ends[of])]
        state = np.full(len(of), 0xFFFFFFFF, np.uint32)
        for k in range(int((stop - at).max())):
            has = at + k < stop
            if has.all():
                state = after[(state ^ raw[at + k]) & 0xFF] ^ (state >> np.uint32(8))
            else:
                some = state[has]
                state[has] = after[(some ^ raw[at[has] + k]) & 0xFF] ^ (some >> np.uint32(8))
        h = ~state
        signs = np.where(h >> np.uint32(31), 1.0, -1.0)
        out += np.bincount(of * dim + (h % np.uint32(dim)).astype(np.int64), signs, len(texts) * dim).reshape(-1, dim).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)

    return encode_texts


def encode(df: DataFrame, id_col: str, text_col: str, make_encoder: Callable[[], Callable] = hashed_ngram_encoder, model: str = "base", max_chars: int | None = 640, batch: int = 256, piece: int = 640) -> DataFrame:
    """(id, model, vec): ``make_encoder`` runs once per task; texts of one batch are encoded in order of length.

    Of a text the first ``max_chars`` characters are read, or all. Those of more than ``piece`` are encoded in pieces,
    whose mean at unit length is the text's vector.
    """

    def run(frames):
        encoder = make_encoder()
        for f in frames:
            whole = [t[:max_chars] for t in f[text_col].fillna("")]
            texts = pd.Series([t[i : i + piece] for t in whole for i in range(0, max(len(t), 1), piece)], dtype=object)
            starts = np.cumsum([0, *(max(1, -(-len(t) // piece)) for t in whole)])
            order = texts.map(len).to_numpy(np.int64).argsort(kind="stable")
            parts = [encoder(texts.iloc[order[i : i + batch]].tolist()) for i in range(0, len(order), batch)]
            vectors = np.concatenate(parts)[np.argsort(order)] if parts else np.zeros((0, 1))
            for i in np.flatnonzero(np.diff(starts) > 1):
                mean = vectors[starts[i] : starts[i + 1]].mean(axis=0)
                vectors[starts[i]] = mean / max(np.linalg.norm(mean), 1e-6)
            yield pd.DataFrame({"id": f[id_col], "model": model, "vec": list(vectors[starts[:-1]].astype(np.float32))})

    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("model", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
    return df.select(id_col, text_col).mapInPandas(run, out)


def mean_pool(df: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """(group, vec): the mean of each component over a group's vectors, in partial sums."""
    each = df.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vec))


def l2_normalize(vec: Column) -> Column:
    """``vec`` at unit length; null components stay null and count nothing."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))
    return F.transform(vec, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-6)))


def ensemble_sim(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean similarity over the models."""
    return scores.groupBy(*keys).agg(F.avg("sim").alias("sim"))


def history_texts(hist: DataFrame) -> DataFrame:
    return hist.select("search_query").distinct()


def query_priors(queries: DataFrame, transitions: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``queries`` with their location's known transitions as two arrays and the floor of all others, for the kernel.

    A location's transitions are as many as the locations chosen from it, so a query row stays small.
    """
    t = transitions.groupBy("s").agg(F.sum("c").alias("total"), F.sort_array(F.collect_list(F.struct("l", "c"))).alias("lc"))
    base = F.lit(alpha * 1e-3)
    known = t.select(F.col("s").alias("loc"), F.transform("lc", lambda r: r["l"]).alias("pl"), F.transform("lc", lambda r: F.log((r["c"].cast("double") + base) / (F.col("total") + F.lit(alpha)))).alias("pv"), F.log(base / (F.col("total") + F.lit(alpha))).alias("floor"))
    out = queries.join(known, "loc", "left")
    return out.withColumns({"pl": F.coalesce("pl", F.array(F.col("loc"))), "pv": F.coalesce("pv", F.array(F.lit(float(np.log(0.8))))), "floor": F.coalesce("floor", F.lit(float(np.log(1e-4))))})


def _spread(n) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))


def _dealt(queries: DataFrame, items: DataFrame, block: int, by_location: bool = False, run: int = 1):
    """Both sides in blocks by hash, each block next to all of the other side's; blocks of items hold ``run`` times ``block``.

    Where locations must be equal, each location has as many blocks of either side as its own rows fill: a crowded
    location doesn't make the rows of others travel more often. The table of locations is broadcast. Few items are cut
    into as many blocks as give each core a pair of blocks.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    if not by_location:
        n, m = queries.count(), items.count()
        nq = max(1, -(-n // block))
        ni = max(1, -(-m // (block * run)), min(-(-m // block), -(-cores // nq)))
        q = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("ib", _spread(ni))
        i = items.withColumn("ib", F.pmod(F.xxhash64("row_id"), F.lit(ni)).cast("int")).withColumn("qb", _spread(nq))
        return q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib"))
    blocks = location_blocks(queries, items, block, run)
    q = queries.join(F.broadcast(blocks), "loc").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")).withColumn("ib", _spread(F.col("ni"))).drop("nq", "ni")
    i = items.join(F.broadcast(blocks), "loc").withColumn("ib", F.pmod(F.xxhash64("row_id"), F.col("ni")).cast("int")).withColumn("qb", _spread(F.col("nq"))).drop("nq", "ni")
    keys = ["loc", "qb", "ib"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys))


def location_blocks(queries: DataFrame, items: DataFrame, block: int, run: int = 1) -> DataFrame:
    """(loc, nq, ni): blocks of either side in each location that both have."""
    count = lambda df, name, size: df.groupBy("loc").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    return count(queries, "nq", block).join(count(items, "ni", block * run), "loc")


def _by_blocks(pairs_of_blocks, kernel: Callable, schema: T.StructType) -> DataFrame:
    """A pandas kernel over pairs of blocks. Results take their types from the schema, so that empty ones have them too."""
    arrow = to_arrow_schema(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(kernel(a.to_pandas(), b.to_pandas()), schema=arrow, preserve_index=False)

    return pairs_of_blocks.applyInArrow(run, schema)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _prior_matrix(a: pd.DataFrame, places: np.ndarray) -> np.ndarray:
    """(queries x places): each query's known log shares, the floor elsewhere; ``places`` are in order."""
    out = np.repeat(a["floor"].to_numpy(np.float64)[:, None], len(places), axis=1)
    row = np.repeat(np.arange(len(a)), [len(x) for x in a["pl"]])
    known, value = np.concatenate(a["pl"].to_numpy()), np.concatenate(a["pv"].to_numpy())
    at = np.minimum(np.searchsorted(places, known), len(places) - 1)
    hit = places[at] == known
    out[row[hit], at[hit]] = value[hit]
    return out


def _best(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest finite scores per row, ties by ``order`` of the columns."""
    keep = np.isfinite(score)
    if score.shape[1] > k:
        keep &= score >= np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    row, col = np.nonzero(keep)
    by = np.lexsort((order[col], -score[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _merged(a: tuple, b: tuple, k: int) -> tuple:
    """The ``k`` best per query of two lists (query, row, .., score), each in order of its queries; ties by row."""
    both = tuple(np.concatenate(x) for x in zip(a, b))
    by = np.lexsort((both[1], -both[-1], both[0]))
    query = both[0][by]
    by = by[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return tuple(x[by] for x in both)


#: Columns of an item that stands in several places: arrays of equal length.
PLACED = ("place_rows", "place_locs", "place_bench", "place_folds")


def placed(items: DataFrame, places: DataFrame) -> DataFrame:
    """``items`` (row_id, ..) with the places they stand in: places has row_id, src_row (null: itself), loc, in_bench, folds.

    A vector is held once, whatever the number of its copies.
    """
    each = F.sort_array(F.collect_list(F.struct("row_id", "loc", "in_bench", F.coalesce("folds", F.array().cast("array<long>")).alias("folds"))))
    by = places.groupBy(F.coalesce("src_row", "row_id").alias("of")).agg(each.alias("p"))
    arrays = [F.col("p")[c].alias(n) for n, c in zip(PLACED, ("row_id", "loc", "in_bench", "folds"))]
    return items.join(by, F.col("row_id") == F.col("of")).select(*items.columns, *arrays)


def _cosines(b: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    """The scores of queries against the block ``b`` of items, a row for each: products of their vectors."""
    y = _vectors(b["vec"])
    return lambda part: _vectors(part["vec"]) @ y.T


def block_topk(queries: DataFrame, items: DataFrame, k: int, weight: float = 0.0, place: str = "any", least: float | None = None, block: int = BLOCK, product: Callable = _cosines, rounds: bool = True, ordered: bool = False) -> DataFrame:
    """(qid, row_id, sim, score): the ``k`` best visible items per query by cosine plus ``weight`` times the log prior.

    queries: qid, vec, and where used loc, fold, and the columns of :func:`query_priors`. items: row_id, vec, and where
    used loc, in_bench, folds; or the columns of :func:`placed`, whose places are listed in the items' stead. Without
    in_bench every item is visible; else as benchmark item or for the query's fold. place: "same" or "other" restricts
    to items inside or outside the query's location; least: smallest cosine.

    Both sides are dealt into blocks by hash; where locations must be equal, blocks lie inside a location. A task goes
    through its items in slabs of ``block``: each is one matrix product, and after the first only pairs that reach the
    k-th best score found so far are rounded, masked and kept, so that a task returns at most k rows per query however
    many slabs it holds. Masks apply before the local top k. Scores are rounded, ties go by row_id; without ``rounds``
    they are rounded for the order only, and ``ordered`` gives the rounded ones as ``by``.

    Another ``product`` than the cosine takes a block of items and returns a function that scores queries against it;
    pairs of score -inf are not listed.
    """
    from pyspark.sql.window import Window

    many = PLACED[0] in items.columns
    if many and place == "same":
        raise ValueError("items with several places are not dealt by location")
    masked = many or "in_bench" in items.columns

    def scorer(b: pd.DataFrame, a: pd.DataFrame) -> tuple:
        """The slab's rows; the cosines and scores of the queries from ``lo`` on; and which of given pairs are hidden."""
        against = product(b)
        if many:
            of = np.repeat(np.arange(len(b)), [len(x) for x in b[PLACED[0]]])
            rows, where, bench = (np.concatenate(b[c].to_numpy()) for c in PLACED[:3])
            folds = [set(f) for x in b[PLACED[3]] for f in x]
        else:
            of, rows = None, b["row_id"].to_numpy()
            where = b["loc"].to_numpy() if "loc" in b else None
            bench = b["in_bench"].to_numpy() if masked else None
            folds = [set() if v is None else set(v) for v in b["folds"]] if masked else None
        if masked:
            fold, fold_of = np.unique(a["fold"].to_numpy(), return_inverse=True)
            seen = np.array([bench.astype(bool) | np.array([f in s for s in folds], bool) for f in fold])
        places, at_place = np.unique(where, return_inverse=True) if weight else (None, None)
        loc = a["loc"].to_numpy() if place == "other" else None

        def scores(lo: int, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            sim = against(part)
            sim = sim if of is None else sim[:, of]
            return sim, sim + weight * _prior_matrix(part, places)[:, at_place] if weight else sim

        def hidden(lo: int, r: np.ndarray, c: np.ndarray, sim: np.ndarray) -> np.ndarray:
            out = ~seen[fold_of[lo + r], c] if masked else np.zeros(sim.shape, bool)
            if place == "other":
                out |= loc[lo + r] == where[c]
            return out if least is None else out | (np.round(sim, DIGITS) < least)

        return rows, scores, hidden

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "row_id": [], "sim": [], "score": [], "by": []})
        starts = range(0, len(a), ASKED)
        best = {lo: None for lo in starts}
        floor = np.full(len(a), -np.inf)
        for at in range(0, len(b), block):
            rows, scores, hidden = scorer(b.iloc[at : at + block], a)
            order = np.argsort(np.argsort(rows, kind="stable"), kind="stable")
            for lo in starts:
                part = a.iloc[lo : lo + ASKED]
                sim, full = scores(lo, part)
                # A hair below the floor, since rounding may lift a score to it.
                near = full >= floor[lo : lo + len(part), None] - 10.0**-DIGITS
                if 8 * np.count_nonzero(near) > near.size:
                    score = np.round(full, DIGITS)
                    score[hidden(lo, np.arange(len(part))[:, None], np.arange(len(rows))[None, :], sim)] = -np.inf
                    r, c = _best(score, order, k)
                    by = score[r, c]
                else:
                    r, c = np.nonzero(near & (full > -np.inf))
                    shown = ~hidden(lo, r, c, sim[r, c])
                    r, c = r[shown], c[shown]
                    by = np.round(full[r, c], DIGITS)
                found = (r, rows[c], sim[r, c], full[r, c], by)
                found = best[lo] = found if best[lo] is None else _merged(best[lo], found, k)
                r = found[0]
                last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
                floor[lo + r[last]] = found[4][last]
        parts = [pd.DataFrame({"qid": a["qid"].to_numpy()[lo + r], "row_id": row, "sim": np.round(sim, DIGITS) if rounds else sim, "score": by if rounds else full, "by": by}) for lo, (r, row, sim, full, by) in best.items()]
        return pd.concat(parts)

    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("row_id", items.schema["row_id"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("sim", "score", "by"))])
    local = _by_blocks(_dealt(queries, items, block, place == "same", RUN), kernel, schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("by"), "row_id"))
    best = local.withColumn("rank", rank).where(F.col("rank") <= k)
    return best if ordered else best.drop("by")


def classes(items: DataFrame, places: DataFrame, content: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct contents of ``items`` as of :func:`placed`, each place standing for all rows alike in content and place.

    A place's row_id is the least of its rows; the second table, (row_id, members), has the first ``k`` of them in order.
    """
    from pyspark.sql.window import Window

    marked = kept(items.withColumn("rep", F.min("row_id").over(Window.partitionBy(*content))), "alike")
    at = places.select(F.col("row_id").alias("member"), F.coalesce("src_row", "row_id").alias("row_id"), "loc", "in_bench", "folds")
    by = Window.partitionBy("rep", "loc", "in_bench", "folds").orderBy("member")
    each = at.join(marked.select("row_id", "rep"), "row_id").withColumns({"rn": F.row_number().over(by), "class": F.first("member").over(by)}).where(F.col("rn") <= k)
    each = kept(each.select("class", "member", "rn", "rep", "loc", "in_bench", "folds"), "classes")
    spots = each.where("rn = 1").select(F.col("class").alias("row_id"), F.col("rep").alias("src_row"), "loc", "in_bench", "folds")
    members = each.groupBy(F.col("class").alias("row_id")).agg(F.sort_array(F.collect_list("member")).alias("members"))
    return kept(placed(marked.where("row_id = rep").drop("rep"), spots), "contents"), kept(members, "members")


def class_topk(queries: DataFrame, items: DataFrame, members: DataFrame, k: int, content: list[str], weight: float = 0.0, transitions: DataFrame | None = None, **options) -> DataFrame:
    """:func:`block_topk` over :func:`classes`: (qid, row_id, score, rank), each list and each class of rows scored once.

    Queries (qid, fold, loc, content) alike in content, fold and, with a ``weight``, location share their list. A row among
    the ``k`` best is of one of the ``k`` best classes, ties going by their least row: each class before its own has a row
    before it. Of these, classes unfold until the rows of better ones are ``k``.
    """
    from pyspark.sql.window import Window

    same = [*content, "fold", *(["loc"] if weight else [])]
    marked = kept(queries.withColumn("rep", F.min("qid").over(Window.partitionBy(*same))), "lists")
    asked = marked.where("qid = rep").drop("rep")
    found = block_topk(query_priors(asked, transitions) if weight else asked, items, k, weight=weight, ordered=True, **options).select("qid", "row_id", "score", "by")
    found = found.join(members.select("row_id", F.size("members").alias("n")), "row_id")
    better = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("by")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(Window.partitionBy("qid", "by"))
    rows = found.withColumn("better", better).where(F.col("better") < k).join(members, "row_id").select("qid", F.explode("members").alias("row_id"), "score", "by")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("by"), "row_id"))
    lists = rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("qid", "rep").drop("by")
    return marked.select("qid", "rep").join(lists, "rep").select("qid", "row_id", "score", "rank")


def count_similar(queries: DataFrame, items: DataFrame, least: float, places: list[str], block: int = BLOCK) -> DataFrame:
    """(qid, one count per name in ``places``): items of cosine ``least`` or more at each of the query's named locations.

    queries: qid, vec and the columns named; items: row_id, vec, loc. A query meets the items of its named locations
    only. Equal vectors at one location are one row with their number on the items' side, and are counted once on the
    queries' side; counts leave the block products, not pairs.
    """
    of = F.sha2(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))), 256)
    each = queries.withColumn("of", of).select("qid", "of", "vec", F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("loc")) for p in places])).alias("p")).select("qid", "of", "vec", "p.name", "p.loc")
    asked = each.groupBy(F.col("of").alias("qid"), "loc").agg(F.first("vec").alias("vec"))
    held = items.groupBy(of.alias("row_id"), "loc").agg(F.first("vec").alias("vec"), F.count("*").alias("n"))

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"of": [], "loc": [], "n": []})
        x, y, times = _vectors(a["vec"]), _vectors(b["vec"]), b["n"].to_numpy()
        n = np.zeros(len(a), np.int64)
        for lo in range(0, len(a), ASKED):
            for at in range(0, len(b), block):
                n[lo : lo + ASKED] += (np.round(x[lo : lo + ASKED] @ y[at : at + block].T, DIGITS) >= least) @ times[at : at + block]
        return pd.DataFrame({"of": a["qid"], "loc": a["loc"], "n": n})

    schema = T.StructType([T.StructField("of", T.StringType()), T.StructField("loc", items.schema["loc"].dataType), T.StructField("n", T.LongType())])
    found = _by_blocks(_dealt(kept(asked), kept(held), block, True), kernel, schema).groupBy("of", "loc").agg(F.sum("n").alias("n"))
    counts = each.drop("vec").join(found, ["of", "loc"], "left")
    return counts.groupBy("qid").agg(*[F.coalesce(F.sum(F.when(F.col("name") == p, F.col("n"))), F.lit(0)).alias(p) for p in places])


def score_pairs(pairs: DataFrame, queries: DataFrame, items: DataFrame, block: int = BLOCK, query_block: int = ASKED) -> DataFrame:
    """(qid, row_id, sim) of given pairs whose ids both sides have.

    Vectors never meet pairs row by row: pairs are dealt by the blocks of their query and their item, vectors travel
    once to every pair of blocks, and each pair's two rows are gathered from the blocks' matrices. Ids are distinct.
    """
    nq, ni = max(1, -(-queries.count() // query_block)), max(1, -(-items.count() // block))
    qb, ib = F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb"), F.pmod(F.xxhash64("row_id"), F.lit(ni)).cast("int").alias("ib")
    q_type, i_type = queries.schema["qid"].dataType, items.schema["row_id"].dataType
    q = queries.select(qb, _spread(ni).alias("ib"), "qid", F.lit(None).cast(i_type).alias("row_id"), "vec")
    i = items.select(_spread(nq).alias("qb"), ib, F.lit(None).cast(q_type).alias("qid"), "row_id", "vec")
    dealt = pairs.select(qb, ib, F.col("qid").alias("asked"), F.col("row_id").alias("found"))

    def kernel(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        first = v["qid"].notna().to_numpy()
        if not len(p) or first.all() or not first.any():
            return pd.DataFrame({"qid": [], "row_id": [], "sim": []})
        a, b = v[first], v[~first]
        x, y = _vectors(a["vec"]), _vectors(b["vec"])
        at, to = pd.Index(a["qid"]).get_indexer(p["asked"]), pd.Index(b["row_id"].astype(p["found"].dtype)).get_indexer(p["found"])
        known = (at >= 0) & (to >= 0)
        p, at, to = p[known], at[known], to[known]
        sim = np.concatenate([np.einsum("ij,ij->i", x[at[k : k + GATHERED]], y[to[k : k + GATHERED]]) for k in range(0, len(p), GATHERED)] or [np.zeros(0)])
        return pd.DataFrame({"qid": p["asked"].to_numpy(), "row_id": p["found"].to_numpy(), "sim": np.round(sim, DIGITS)})

    out = T.StructType([T.StructField("qid", q_type), T.StructField("row_id", i_type), T.StructField("sim", T.DoubleType())])
    return _by_blocks(dealt.groupBy("qb", "ib").cogroup(q.unionByName(i).groupBy("qb", "ib")), kernel, out)
