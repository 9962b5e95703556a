"""Boosted classification over histograms: Spark's model and steps, grown in fewer and lighter passes.

The loss, the weight of the first tree, the drawing of rows and features, the gain of a split
and the limits of a tree are those of ``GBTClassifier``, and so is the model. Rows are binned
once and held as bytes, a few features in each number, so one count of a number's values gives the
histograms of its features. A level of a tree is one job: tasks add up the histograms of the
smaller child of each split, the driver takes the larger one as what its parent has left, and
chooses the splits. The job that begins a round also scores the validation rows, so boosting ends
where its patience does and repeats no round. Few rows are grown by one task without a job in between.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of splits of a tree, and the share of rows that a round and of features that a split draws.
DEPTH, SHARE = 6, 0.8
#: Rows that are worked on at once, and values of the number that holds the bins of some features.
CHUNK_ROWS, GROUP_SIZE = 131_072, 1024
#: Rows that are worth a task of a level, whose own cost is that of some hundred thousand; up to these one task needs no jobs.
TASK_ROWS = 1_000_000
#: Rows that a task may hold where fits share the cores.
MOST_ROWS = 5_000_000
#: Rounds between written states: lost ones are computed again from the last.
CHECKPOINT_ROUNDS = 10


def grouped(sizes: Sequence[int], most: int = GROUP_SIZE) -> list[list[int]]:
    """Features that share a number: as many as have ``most`` sets of bins at most; the widest come first."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        fitting = (g for g in groups if math.prod(sizes[i] for i in g) * sizes[f] <= most)
        found = next(fitting, None)
        if found is None:
            groups.append([f])
        else:
            found.append(f)
    return groups


def binned(cuts: Sequence[Sequence[float]], groups: Sequence[Sequence[int]], names: Sequence[str], rows: int = CHUNK_ROWS):
    """Arrow batches of features, ``_y`` and ``_grows`` as pickled chunks: grown on or not, packed bins, labels of -1 and 1."""

    edges = [np.asarray(c, dtype="float64") for c in cuts]

    def pack(batches):
        import pyarrow as pa

        held = {True: [], False: []}

        def chunk(grows):
            parts = held[grows]
            packed = np.concatenate([p for p, _ in parts], axis=1)
            y = np.concatenate([y for _, y in parts])
            held[grows] = []
            return pa.RecordBatch.from_pydict({"chunk": pa.array([pickle.dumps((grows, packed, y), 5)], pa.binary())})

        for batch in batches:
            bins = []
            for name, edge in zip(names, edges):
                column = batch.column(batch.schema.get_field_index(name))
                values = column.to_numpy(zero_copy_only=False)
                if column.null_count or np.isnan(values).any():
                    raise ValueError(f"{name} has rows without a value")
                bins.append(np.searchsorted(edge, values, side="right"))
            packed = np.zeros((len(groups), batch.num_rows), dtype="uint16")
            for g, group in enumerate(groups):
                for f in group:
                    packed[g] = packed[g] * (len(edges[f]) + 1) + bins[f].astype("uint16")
            label = batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)
            y = np.where(label == 1, 1, -1).astype("int8")
            on = batch.column(batch.schema.get_field_index("_grows")).to_numpy(zero_copy_only=False).astype(bool)
            for grows in (True, False):
                mine = on == grows
                if mine.any():
                    held[grows].append((packed[:, mine], y[mine]))
                    if sum(len(y_) for _, y_ in held[grows]) >= rows:
                        yield chunk(grows)
        for grows in (True, False):
            if held[grows]:
                yield chunk(grows)

    return pack


def booster(
    sizes: Sequence[int], groups: Sequence[Sequence[int]], *, heavy: float, rounds: int, patience: int, seed: int, step: float,
    depth: int = DEPTH, share: float = SHARE,
):
    """``begin`` of a state and ``grow`` over one: closures over numpy only, so tasks need nothing else.

    ``grow(visit, advance)`` asks for visits of all chunks (a function of their task's
    number and the chunks, with a result for each task) and for new chunks. Trees are dicts
    of the splits and sums of each level.
    """
    n_features, most = len(sizes), max(2, *sizes)
    width = max(math.prod(sizes[f] for f in g) for g in groups)
    group_of = {f: g for g, group in enumerate(groups) for f in group}
    weights, lightest = np.array([0.0, 1.0, heavy]), min(1.0, heavy)
    slots = 2**depth

    def drawn(y, margin, k, task, n):
        """The weight class of each row that round ``k`` draws, 0 for the others, and its weighted residual."""
        chosen = np.random.default_rng([seed, k, task, n, 0]).random(len(y), dtype="float32") < share
        kind = np.where(chosen, np.where(y > 0, 2, 1), 0).astype("uint8")
        residual = y.astype("float64") if k == 0 else 4.0 * y / (1.0 + np.exp(np.clip(2.0 * y * margin.astype("float64"), -700, 700)))
        return kind, (residual * weights[kind]).astype("float32")

    def begin(task, chunks):
        for n, (grows, packed, y) in enumerate(chunks):
            margin = np.zeros(len(y), dtype="float32")
            kind, residual = drawn(y, margin, 0, task, n) if grows else (None, None)
            yield grows, packed, y, margin, kind, residual, None

    def sides(features, cuts):
        """For each node of a level, the group it asks and whether a value of it goes right; a leaf's rows all go left."""
        asked, right = np.zeros(len(features), dtype="int64"), np.zeros((len(features), width), dtype="int64")
        for i, (f, cut) in enumerate(zip(features, cuts)):
            if f >= 0:
                asked[i] = group = group_of[f]
                after = groups[group][groups[group].index(f) + 1 :]
                value = np.arange(width) // math.prod(sizes[a] for a in after) % sizes[f]
                right[i] = value > cut
        return asked, right.ravel()

    def nodes(packed, rows, levels):
        """The node that each of ``rows`` reaches below ``levels``."""
        flat, n = packed.ravel(), packed.shape[1]
        node = np.zeros(len(rows), dtype="int64")
        for asked, right in levels:
            value = flat.take(asked.take(node) * n + rows)
            node = 2 * node + right.take(node * width + value)
        return node

    def look(splits, slot):
        """Visit: the histograms of the nodes with a ``slot``, and what the state knows of the last tree."""

        def visit(task, chunks):
            levels = [sides(*s) for s in splits]
            count = int(slot.max()) + 1
            hist = [np.zeros((2, count * math.prod(sizes[f] for f in g))) for g in groups]
            loss, weight, leaves = 0.0, 0.0, np.zeros((2, slots))
            for grows, packed, y, margin, kind, residual, last in chunks:
                if not grows:
                    if not splits:
                        w = weights[np.where(y > 0, 2, 1)]
                        loss += float((w * 2.0 * np.logaddexp(0.0, -2.0 * y * margin.astype("float64"))).sum())
                        weight += float(w.sum())
                    continue
                if last is not None:
                    leaves += last
                if not count:
                    continue
                rows = np.flatnonzero(kind)
                place = slot.take(nodes(packed, rows, levels))
                if place.size and place.min() < 0:
                    there = np.flatnonzero(place >= 0)
                    rows, place = rows.take(there), place.take(there)
                r, w = residual.take(rows).astype("float64"), weights.take(kind.take(rows))
                for g, group in enumerate(groups):
                    size = math.prod(sizes[f] for f in group)
                    at = place * size + packed[g].take(rows)
                    hist[g][0] += np.bincount(at, r, minlength=count * size)
                    hist[g][1] += np.bincount(at, w, minlength=count * size)
            out = np.zeros((2, count, n_features, most))
            for g, group in enumerate(groups):
                shaped = hist[g].reshape(2, count, *(sizes[f] for f in group))
                for axis, f in enumerate(group):
                    other = tuple(2 + a for a in range(len(group)) if a != axis)
                    out[:, :, f, : sizes[f]] = shaped.sum(axis=other) if other else shaped
            return out, loss, weight, leaves

        return visit

    def grown(tree, weight, k):
        """The chunks after the tree: new margins, and the draw and residuals of round ``k``."""

        def advance(task, chunks):
            levels = [sides(*s) for s in tree["splits"]]
            down = depth - len(levels)
            for n, (grows, packed, y, margin, kind, residual, _) in enumerate(chunks):
                leaf = nodes(packed, np.arange(len(y)), levels) << down
                margin = (margin + weight * tree["leaves"].take(leaf)).astype("float32")
                last = None
                if grows:
                    used = np.flatnonzero(kind)
                    square = residual.take(used).astype("float64") ** 2 / weights.take(kind.take(used))
                    leaf = leaf.take(used)
                    last = np.array([np.bincount(leaf, square, minlength=slots), np.bincount(leaf, minlength=slots)])
                    kind, residual = drawn(y, margin, k, task, n)
                yield grows, packed, y, margin, kind, residual, last

        return advance

    def chosen(hist, k, level, active):
        """The best split of each active node: its feature, the last bin that goes left, the gain, and the left sums."""
        rng, drawn_features = np.random.default_rng([seed, k, level, 1, 1]), math.ceil(share * n_features)
        allowed = np.zeros((len(active), n_features), dtype=bool)
        for i in range(len(active)):
            allowed[i, rng.permutation(n_features)[:drawn_features]] = True
        total = hist[:, :, :1, :].sum(axis=3, keepdims=True)
        left = hist.cumsum(axis=3)[:, :, :, :-1]
        right = total - left
        real = (left[1] >= lightest / 2) & (right[1] >= lightest / 2) & allowed[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(real, left[0] ** 2 / left[1] + right[0] ** 2 / right[1], -np.inf)
        flat = score.reshape(len(active), -1)
        best = flat.argmax(axis=1)
        f, cut = np.divmod(best, left.shape[3])
        at = np.arange(len(active))
        value, (s, w) = flat[at, best], total[:, :, 0, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            better = value - s * s / w
            gain = np.where(better > 1e-11 * value, better / w, 0.0)
        return f, cut, gain, left[:, at, f, cut]

    def grow(visit, advance):
        trees, losses, best = [], [], 0

        def known(parts):
            """What the state knows of the last tree; whether boosting goes on."""
            nonlocal best
            if trees:
                trees[-1]["rows"] = sum(p[3] for p in parts)
                scored = sum(p[2] for p in parts)
                if scored > 0:
                    losses.append(sum(p[1] for p in parts) / scored)
                    if losses[-1] < losses[best]:
                        best = len(losses) - 1
                    elif len(losses) - 1 - best >= patience:
                        return False
            return True

        for k in range(rounds):
            tree = {"splits": [], "sums": [], "gains": []}
            active, slot, parent = np.zeros(1, dtype="int64"), np.zeros(1, dtype="int64"), None
            for level in range(depth):
                parts = visit(look(list(tree["splits"]), slot))
                if level == 0 and not known(parts):
                    return trees[: best + 1]
                hist = sum(p[0] for p in parts)
                if parent is not None:
                    # siblings follow each other; the one with a slot was counted
                    full = np.empty((2, len(active), *hist.shape[2:]))
                    counted = slot[active]
                    for i in range(0, len(active), 2):
                        mine = i if counted[i] >= 0 else i + 1
                        full[:, mine] = hist[:, counted[mine]]
                        full[:, 2 * i + 1 - mine] = parent[:, i // 2] - full[:, mine]
                    hist = full
                f, cut, gain, left = chosen(hist, k, level, active)
                if level == 0:
                    tree["sums"].append(hist[:, :, 0, :].sum(axis=2))
                split = gain > 0
                wide = 2**level
                features, cuts, gains = np.full(wide, -1), np.zeros(wide, dtype="int64"), np.zeros(wide)
                features[active[split]], cuts[active[split]], gains[active[split]] = f[split], cut[split], gain[split]
                if not split.any():
                    break
                tree["splits"].append((features, cuts))
                tree["gains"].append(gains)
                sums = np.zeros((2, 2 * wide))
                sums[:, 2 * active[split]] = left[:, split]
                sums[:, 2 * active[split] + 1] = tree["sums"][-1][:, active[split]] - left[:, split]
                tree["sums"].append(sums)
                parent, at = hist[:, split], active[split]
                active = np.stack([2 * at, 2 * at + 1], axis=1).ravel()
                smaller = 2 * at + (sums[1][2 * at] > sums[1][2 * at + 1])
                slot = np.full(2 * wide, -1)
                slot[smaller] = np.arange(len(at))
            leaves = np.zeros(slots)
            for level, (s, w) in enumerate(tree["sums"]):
                there = np.flatnonzero(w > 0)
                leaves[there << (depth - level)] = s[there] / w[there]
            tree["leaves"] = leaves
            trees.append(tree)
            advance(grown(tree, 1.0 if k == 0 else step, k + 1))
        known(visit(look([], np.full(1, -1))))
        return trees[: best + 1] if losses else trees

    return begin, grow


def by_tasks(chunks: RDD, begin, grow) -> list[dict]:
    """Trees grown over chunks of many tasks: a level is a job, a round a state that stays where it is."""
    sc = chunks.ctx
    state = [chunks.mapPartitionsWithIndex(begin, True).persist(StorageLevel.MEMORY_AND_DISK)]
    outdated, written, rounds = [], [], 0

    def visit(look):
        found = state[0].mapPartitionsWithIndex(lambda task, held: [look(task, held)], True).collect()
        while outdated:
            outdated.pop().unpersist()
        while len(written) > 1 and written[1].isCheckpointed():
            _drop(sc, written.pop(0))
        return found

    def advance(step):
        nonlocal rounds
        rounds += 1
        after = state[0].mapPartitionsWithIndex(step, True).persist(StorageLevel.MEMORY_AND_DISK)
        if rounds % CHECKPOINT_ROUNDS == 0 and sc.getCheckpointDir():
            after.checkpoint()
            written.append(after)
        outdated.append(state[0])
        state[0] = after

    try:
        return grow(visit, advance)
    finally:
        for rdd in (*outdated, state[0]):
            rdd.unpersist()
        for rdd in written:
            if rdd.isCheckpointed():
                _drop(sc, rdd)


def tasks_for(rows: int, cores: int, beside: int = 1) -> int:
    """Tasks of a level: at most one for each core, as they go through their rows chunk by chunk.

    Of ``beside`` fits that run side by side each has its share of the cores, as long as a task's rows are not too many to hold.
    """
    share = max(cores // beside, min(cores, -(-rows // MOST_ROWS)))
    return max(1, min(share, -(-rows // TASK_ROWS)))


def _drop(sc: SparkContext, rdd: RDD) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def in_one_task(chunks: RDD, begin, grow) -> list[dict]:
    """Trees grown over the chunks of a single task, without leaving it."""

    def whole(task, held):
        state = [list(begin(task, held))]

        def advance(step):
            state[0] = list(step(task, state[0]))

        yield grow(lambda look: [look(task, state[0])], advance)

    return chunks.mapPartitionsWithIndex(whole, True).collect()[0]


def classifier(
    rows: DataFrame, cuts: Sequence[Sequence[float]], estimator: GBTClassifier, features: Sequence[str], *, target: str, grows,
    heavy: float, patience: int, tasks: int,
) -> GBTClassificationModel:
    """The model that ``estimator`` describes, grown on the rows that satisfy ``grows`` and cut to the round that scores best on the others.

    ``cuts`` are the least values of each feature's bins after the first, ``heavy`` the weight of a positive row.
    A single one of ``tasks`` grows the trees by itself.
    """
    sizes = [len(c) + 1 for c in cuts]
    groups = grouped(sizes)
    begin, grow = booster(
        sizes, groups, heavy=heavy, rounds=estimator.getMaxIter(), patience=patience, seed=estimator.getSeed() & 0x7FFFFFFF,
        step=estimator.getStepSize(), depth=estimator.getMaxDepth(), share=estimator.getSubsamplingRate(),
    )
    names = [f"_f{k}" for k in range(len(features))]
    columns = [F.col(c).cast("double").alias(n) for c, n in zip(features, names)]
    seen = rows.select(*columns, F.col(target).cast("int").alias("_y"), grows.alias("_grows")).coalesce(tasks)
    chunks = seen.mapInArrow(binned(cuts, groups, names), "chunk binary").rdd.map(lambda row: pickle.loads(row[0]))
    trees = (in_one_task if tasks == 1 else by_tasks)(chunks, begin, grow)
    return spark_model(trees, cuts, estimator)


def spark_model(trees: Sequence[dict], cuts: Sequence[Sequence[float]], estimator: GBTClassifier) -> GBTClassificationModel:
    """The trees as a model of Spark's: a value goes left that is below the first one of the bins on the right."""
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    kinds, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression
    variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def numbers(values):
        held = gateway.new_array(gateway.jvm.double, len(values))
        for k, v in enumerate(values):
            held[k] = float(v)
        return held

    def node(tree, squares, counts, level, i):
        s, w = (float(x) for x in tree["sums"][level][:, i])
        mean = s / w if w else 0.0
        square = max(float(squares[level][i]), s * mean)
        known = variance(numbers([w, s, square]), int(counts[level][i]))
        impurity = max(0.0, square / w - mean**2) if w else 0.0
        f = int(tree["splits"][level][0][i]) if level < len(tree["splits"]) else -1
        if f < 0:
            return kinds.LeafNode(mean, impurity, known)
        below = [node(tree, squares, counts, level + 1, 2 * i + k) for k in (0, 1)]
        cut = float(np.nextafter(cuts[f][int(tree["splits"][level][1][i])], -np.inf))
        return kinds.InternalNode(mean, impurity, float(tree["gains"][level][i]), *below, kinds.ContinuousSplit(f, cut), known)

    held = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    for k, tree in enumerate(trees):
        squares, counts = ([x.reshape(2**d, -1).sum(axis=1) for d in range(estimator.getMaxDepth() + 1)] for x in tree["rows"])
        root = node(tree, squares, counts, 0, 0)
        held[k] = regression.DecisionTreeRegressionModel(f"{estimator.uid}_{k}", root, len(cuts))
    shares = numbers([1.0, *[estimator.getStepSize()] * (len(trees) - 1)])
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(estimator.uid, held, shares, len(cuts), 2)
    model = GBTClassificationModel(java)
    for param in estimator.params:
        if estimator.isSet(param) and model.hasParam(param.name):
            model.set(model.getParam(param.name), estimator.getOrDefault(param))
    model._transfer_params_to_java()
    return model
