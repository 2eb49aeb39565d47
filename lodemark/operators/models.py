"""Out-of-sample probabilities of a random forest, window by window.

One fit a window through Spark ML, whose histogram trees grow level by level
over all partitions. Rows are dealt by position and sorted, so that a seed gives
the same forest on every run. The loop runs over windows, of which there are as
many as the calendar has room for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import cut_lineage

# The forest and the bars that features need before they are valid.
TREES, DEPTH, LEAST_ROWS, SEED, WARM_UP = 300, 6, 25, 42, 600


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows / (2 * rows of the class)."""
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two classes
    total = sum(sizes.values())
    return rows.withColumn("weight", F.when(F.col(label) == 1, total / (2 * sizes.get(1, total))).otherwise(total / (2 * sizes.get(0, total))))


def forest(features: list[str], label: str, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_ROWS, seed: int = SEED) -> Pipeline:
    trees_ = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), trees_])


def oos_probabilities(
    rows: DataFrame, features: list[str], label: str, pos: str, windows: list[tuple[int, int, int]], warm_up: int = WARM_UP, horizon: int = 1, parts: int = 8, **how: int
) -> DataFrame:
    """The rows of every test slice with window and probability. A window is (start, train_end, test_end) on pos; its first warm_up rows and
    its last `horizon` ones, whose label the test slice would give away, do not train. Rows lacking a feature or label do not train either,
    those lacking a feature have no probability; a window with one class only gives that class."""
    rows = cut_lineage(rows.filter(F.col(pos).isNotNull()))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    out = []
    for number, (start, train_end, test_end) in enumerate(windows, 1):
        train = rows.filter(whole & F.col(label).isNotNull() & F.col(pos).between(start + warm_up, train_end - 1 - horizon))
        train = train.repartition(parts, pos).sortWithinPartitions(*[c for c in rows.columns if c not in features])
        kinds = [r[0] for r in train.select(label).distinct().collect()]
        test = rows.filter(whole & F.col(pos).between(train_end, test_end - 1)).withColumn("window", F.lit(number))
        if len(kinds) == 2:
            model = forest(features, label, **how).fit(balanced(train, label))
            got = model.transform(test).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
            out.append(got.select(*rows.columns, "window", "probability"))
        elif kinds:
            out.append(test.withColumn("probability", F.lit(float(kinds[0]))))
    return reduce(DataFrame.unionByName, out) if out else rows.limit(0).withColumns({"window": F.lit(0), "probability": F.lit(0.0)})
