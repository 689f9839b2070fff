"""Gradient vectors: norms, cosines, Gram matrices in blocks, minibatch alignment; directions are in ``spectrum``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import numeric as N
from gaugeframe.functions.stats import ratio
from gaugeframe.operators.quantiles import exact_quantile
from gaugeframe.operators.resampling import HELD, ROWS
from gaugeframe.operators.sampling import joined, ranged, sliced_rank
from gaugeframe.operators.tables import cut


def norm_summary(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Mean, median and root mean square of the row norms."""
    rows = df.withColumn("_n", N.norm(F.col(vector)))
    means = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("_n").alias("mean_norm"), F.sqrt(F.avg(F.col("_n") * F.col("_n"))).alias("rms_norm"))
    return joined(means, exact_quantile(rows, "_n", 0.5, by, "median_norm"), by)


def mean_vectors(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """The mean vector of each group, by element sums that combine before the shuffle."""
    cells = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))


def alignment(sources: DataFrame, targets: DataFrame, vector: str) -> DataFrame:
    """Cosine of every source and target mean: a matrix with a row a task on both sides, checked."""
    s, t = sources.withColumnRenamed(vector, "_s"), targets.withColumnRenamed(vector, "_t")
    if t.count() > MOST_POOL:
        raise ValueError(f"more than {MOST_POOL} targets")
    return s.join(F.broadcast(t)).withColumn("alignment", N.cosine(F.col("_s"), F.col("_t"))).drop("_s", "_t")


#: Rows and coordinates of a block, and rows of a pool of which a Gram matrix is asked for at most: the matrix of a pool
#: is held by one task (8 bytes a pair), so more is an error.
BLOCK, WIDTH, MOST_POOL = 512, 2048, 8192


def _pool(df: DataFrame, key: str, *more: str) -> list:
    """The keys of a pool in order, with further columns; the driver holds a few numbers a row."""
    rows = df.select(key, *more).limit(MOST_POOL + 1).collect()
    if len(rows) > MOST_POOL:
        raise ValueError(f"a pool of more than {MOST_POOL} rows")
    rows = sorted(rows, key=lambda r: r[key])
    if len({r[key] for r in rows}) < len(rows):
        raise ValueError(f"repeated {key} in a pool")
    return rows


def gram_blocks(df: DataFrame, key: str, vector: str, keys: list) -> DataFrame:
    """(bi, bj, dots): the blocks bi <= bj of the Gram matrix of the rows in the order of ``keys``, as bytes of doubles.

    Vectors are cut into pieces of ``WIDTH`` coordinates. The pieces of two row blocks meet in a task, which multiplies
    them as matrices; products are summed over the pieces. A piece is sent once for each row block, never once a row.
    """
    place = {k: i for i, k in enumerate(keys)}
    blocks = -(-len(keys) // BLOCK) or 1

    @F.pandas_udf("int")
    def number(k: pd.Series) -> pd.Series:
        return k.map(place).astype("int32")

    rows = df.select(number(F.col(key)).alias("r"), F.col(vector).cast("array<double>").alias("x")).withColumn("b", F.floor(F.col("r") / BLOCK).cast("int"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / WIDTH).cast("int")), lambda c: F.struct(c.alias("c"), F.slice("x", c * WIDTH + 1, WIDTH).alias("x")))
    pieces = rows.where(F.size("x") > 0).select("r", "b", F.explode(cuts).alias("p")).select("r", "b", "p.c", "p.x")
    met = pieces.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "c", "r", "b", "x")

    def multiply(g: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(g["bi"].iloc[0]), int(g["bj"].iloc[0])
        side = lambda b: g[g["b"] == b]
        out = np.zeros((min(BLOCK, len(keys) - bi * BLOCK), min(BLOCK, len(keys) - bj * BLOCK)))
        left, right = side(bi), side(bj)
        if len(left) and len(right):
            out[np.ix_(left["r"] - bi * BLOCK, right["r"] - bj * BLOCK)] = np.stack(left["x"].to_numpy()) @ np.stack(right["x"].to_numpy()).T
        return pd.DataFrame({"bi": [bi], "bj": [bj], "dots": [out.tobytes()]})

    def total(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[:1].assign(dots=[sum(np.frombuffer(x) for x in g["dots"]).tobytes()])

    schema = "bi int, bj int, dots binary"
    return met.groupBy("bi", "bj", "c").applyInPandas(multiply, schema).groupBy("bi", "bj").applyInPandas(total, schema)


def _assembled(blocks: pd.DataFrame, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for bi, bj, dots in zip(blocks["bi"], blocks["bj"], blocks["dots"], strict=True):
        i, j = slice(bi * BLOCK, min(n, (bi + 1) * BLOCK)), slice(bj * BLOCK, min(n, (bj + 1) * BLOCK))
        out[i, j] = np.frombuffer(dots).reshape(i.stop - i.start, j.stop - j.start)
        out[j, i] = out[i, j].T
    return out


def gram(df: DataFrame, key: str, vector: str) -> DataFrame:
    """V1: the Gram matrix as (i, j, dot), i <= j, of a pool of at most ``MOST_POOL`` rows with distinct keys."""
    keys = [r[0] for r in _pool(df, key)]
    kind = dict(df.dtypes)[key]

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bi, bj, dots in zip(b["bi"], b["bj"], b["dots"], strict=True):
                i, j = keys[bi * BLOCK : (bi + 1) * BLOCK], keys[bj * BLOCK : (bj + 1) * BLOCK]
                at = np.triu_indices(len(i), 0, len(j)) if bi == bj else np.indices((len(i), len(j))).reshape(2, -1)
                yield pd.DataFrame({"i": [i[x] for x in at[0]], "j": [j[x] for x in at[1]], "dot": np.frombuffer(dots).reshape(len(i), len(j))[tuple(at)]})

    return gram_blocks(df, key, vector, keys).mapInPandas(spelled, f"i {kind}, j {kind}, dot double")


def zero_rows(df: DataFrame, vector: str, least: float = 1e-24) -> DataFrame:
    """Rows whose squared norm isn't above ``least``: a gradient that is structurally zero."""
    return df.where(N.dot(F.col(vector), F.col(vector)) <= least)


def narrowed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``df`` with each vector replaced by as many coordinates as the pool has rows, so that all dot products stay: for
    vectors that are longer than a bounded pool has rows. The Gram matrix is made in blocks; one task turns it."""
    keys = [r[0] for r in _pool(df, key)]
    kind = dict(df.dtypes)[key]

    def turn(b: pd.DataFrame) -> pd.DataFrame:
        values, axes = np.linalg.eigh(_assembled(b, len(keys)))
        return pd.DataFrame({"_key": keys, "_coordinates": list(axes * np.sqrt(np.maximum(values, 0)))})

    turned = gram_blocks(df, key, vector, keys).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(turn, f"_key {kind}, _coordinates array<double>")
    return df.drop(vector).join(turned, F.col(key) == F.col("_key")).drop("_key").withColumnRenamed("_coordinates", vector)


def blocks_of(parameters: DataFrame, module: str = "module", name: str = "name") -> DataFrame:
    """Each parameter once with its module and once by itself: (module, parameter or null, name)."""
    return parameters.select(F.col(module).alias("module"), F.explode(F.array(F.lit(None).cast("string"), F.col(name))).alias("parameter"), F.col(name).alias("name"))


# What a weight's name holds, and the module that it belongs to.
NORMS = {"input_layernorm": "input_ln", "post_attention_layernorm": "post_attn_ln", "q_norm": "q_norm", "k_norm": "k_norm", "embed_tokens": "embed_tokens"}
PROJECTIONS = r"\.(self_attn\.[qkvo]_proj|mlp\.(?:gate|up|down)_proj)\.weight$"
VISION = r"^vit_model\.vision_model\.(?:encoder\.layers\.\d+\.|embeddings\.)?"


def module_of(name: Column) -> Column:
    """The module of a parameter by its name; null for parameters that aren't looked at."""
    weight = F.endswith(name, F.lit("weight"))
    language = F.when(name == "language_model.model.norm.weight", F.lit("llm.final_norm.weight"))
    for part, family in NORMS.items():
        language = language.when(F.contains(name, F.lit(part)), F.lit(f"llm.{family}.weight"))
    projection = F.regexp_extract(name, PROJECTIONS, 1)
    language = language.when(projection != "", F.concat(F.lit("llm."), projection, F.lit(".weight")))
    found = F.when(F.startswith(name, F.lit("language_model.")) & weight, language)
    found = found.when(F.startswith(name, F.lit("vit_model.")) & weight, F.concat(F.lit("vit."), F.regexp_replace(name, VISION, "")))
    found = found.when(F.startswith(name, F.lit("connector.")), name).when(name == "vit_pos_embed.pos_embed", F.lit("connector.vit_pos_embed"))
    return F.when(~F.contains(name, F.lit("_moe_gen")), found)


def draws(seed: int, key: str, n: int, repeats: int, width: int = 128) -> np.ndarray:
    """With-replacement row numbers, the same for every prefix of the width."""
    import hashlib

    start = int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "little") % (2**63 - 1)
    return np.random.default_rng(start).integers(n, size=(repeats, width), dtype=np.int32)


def minibatch_directions(x: np.ndarray, tokens: np.ndarray, schedule: np.ndarray, batch: int) -> np.ndarray:
    """V9, for a pool that a task holds: of each draw the unit vector of its token-weighted sum: how often a row was drawn, times its tokens, times it."""
    n, repeats = len(x), len(schedule)
    if not (np.isfinite(tokens).all() and (tokens > 0).all()) or not 1 <= batch <= schedule.shape[1]:
        raise ValueError("token weights must be positive, and a batch no wider than the schedule")
    flat = schedule[:, :batch] + n * np.arange(repeats)[:, None]
    drawn = np.bincount(flat.ravel(), minlength=n * repeats).reshape(repeats, n)
    sums = (drawn * tokens) @ x
    return sums / np.linalg.norm(sums, axis=1)[:, None]


def _drawn(groups: DataFrame, repeats: int, batch: int, seed: int) -> DataFrame:
    """(task, side, fold, i, draws): of each row that is drawn at all, the draws that take it, as often as they do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g in b.itertuples(index=False):
                schedule = draws(seed, f"point:{g.task}:{g.side}:fold:{g.fold}", g.n, repeats)[:, :batch]
                order = np.argsort(schedule.ravel(), kind="stable")
                own, starts = np.unique(schedule.ravel()[order], return_index=True)
                yield pd.DataFrame({"task": g.task, "side": g.side, "fold": g.fold, "i": own, "draws": np.split((order // batch).astype(np.int32), starts[1:])})

    return groups.mapInPandas(run, "task string, side string, fold int, i int, draws array<int>")


def _sums_of_draws(rows: DataFrame, repeats: int) -> DataFrame:
    """V9: (task, side, fold, draw, sum): of each draw the token-weighted sum: how often a row was drawn, times its tokens,
    times it. A task multiplies rows by draws and leaves one sum for each draw that it has met; it holds ``HELD`` numbers."""
    where = ["task", "side", "fold"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on() -> Iterator[pd.DataFrame]:
            for own, (sums, met) in held.items():
                yield pd.DataFrame(dict(zip(where, own)) | {"draw": np.flatnonzero(met), "sum": list(sums[met])})
            held.clear()

        for b in batches:
            for own, g in b.groupby(where):
                for at in range(0, len(g), ROWS):
                    part = g.iloc[at : at + ROWS]
                    x, drawn = np.stack(part["x"].to_numpy()), np.zeros((repeats, len(part)))
                    np.add.at(drawn, (np.concatenate(part["draws"].to_numpy()), np.repeat(np.arange(len(part)), part["draws"].str.len())), 1)
                    sums, met = held.setdefault(own, (np.zeros((repeats, x.shape[1])), np.zeros(repeats, bool)))
                    sums += (drawn * part["tokens"].to_numpy()) @ x
                    met |= drawn.any(1)
                if sum(s.size for s, _ in held.values()) > HELD:
                    yield from hand_on()
        yield from hand_on()

    parts = rows.select(*where, "x", "tokens", "draws").mapInPandas(run, "task string, side string, fold int, draw int, sum array<double>")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    every = F.array_sort(F.collect_list("sum"))
    return parts.groupBy(*where, "draw").agg(F.aggregate(F.slice(every, 2, F.size(every)), every[0], add).alias("sum"))


def minibatch_alignment(df: DataFrame, vector: str, task: str, side: str, fold: str, tokens: str, key: str, repeats: int = 200, batch: int = 16, seed: int = 7) -> DataFrame:
    """Cosine of source ('i2i') and target ('i2t') directions over draws, fold by fold, then the mean over
    folds weighted by the target's share, its Monte-Carlo standard error, and how far the first half of the draws is off.

    Pools may have any number of rows: rows are numbered in ranges of their keys, and those that no draw takes go before
    anything is multiplied. Directions of a fold meet draw by draw."""
    if not 1 <= batch <= draws(seed, "", 1, 1).shape[1]:
        raise ValueError("a batch must not be wider than the schedule")
    where = ["task", "side", "fold"]
    weight = F.col(tokens).cast("double")
    weight = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(F.raise_error(F.lit("token weights must be positive")).cast("double"))
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(task).cast("string").alias("task"), F.col(side).alias("side"), F.col(fold).cast("int").alias("fold"), weight.alias("tokens"), F.col(key).cast("string").alias("key"))
    rows = ranged(rows.where("task IS NOT NULL AND side IN ('i2i', 'i2t')"), *where, "key")
    groups = cut(rows.groupBy(*where).agg(F.count("*").alias("n")))
    numbered = sliced_rank(rows, where, "_piece", ["key"], "i")
    sums = _sums_of_draws(numbered.join(_drawn(groups, repeats, batch, seed), [*where, "i"]), repeats)
    units = cut(sums.select(*where, "draw", N.unit(F.col("sum")).alias("u")))
    of = lambda s, name: units.where(F.col("side") == s).select("fold", "draw", F.col("task").alias(name), F.col("u").alias(f"_{name}"))
    pairs = of("i2i", "source").join(of("i2t", "target"), ["fold", "draw"]).select("source", "target", "fold", "draw", N.dot(F.col("_source"), F.col("_target")).alias("c"))
    each = pairs.groupBy("source", "target", "fold").agg(F.avg("c").alias("mean"), F.var_samp("c").alias("variance"), F.avg(F.when(F.col("draw") < repeats // 2, F.col("c"))).alias("half"))
    each = each.join(groups.where("side = 'i2t'").select(F.col("task").alias("target"), "fold", "n"), ["target", "fold"])
    sums = {"_m": F.col("mean") * F.col("n"), "_v": F.col("variance") * F.col("n") * F.col("n") / repeats, "_h": F.col("half") * F.col("n")}
    weighted = each.groupBy("source", "target").agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.sum("n").alias("n"))
    mean = ratio(F.col("_m"), F.col("n"))
    return weighted.select("source", "target", "n", mean.alias("alignment"), (F.sqrt("_v") / F.col("n")).alias("mcse"), (mean - ratio(F.col("_h"), F.col("n"))).alias("prefix_difference"))


def count_sketch(vector: Column, buckets: int, seed: int = 0) -> Column:
    """V7: a random sign and bucket for each coordinate; dot products are kept in expectation (not bit for bit those
    of another generator)."""
    at = F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(buckets)))
    signed = F.zip_with(vector, F.sequence(F.lit(0), F.size(vector) - 1), lambda x, i: x.cast("double") * F.when(F.pmod(F.xxhash64(i, F.lit(seed + 1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.arrays_zip(at.alias("b"), signed.alias("x"))
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.aggregate(F.filter(pairs, lambda p: p["b"] == b), F.lit(0.0), lambda acc, p: acc + p["x"]))
