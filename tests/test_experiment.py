import json

import pytest
from pyspark.sql import functions as F

from rarespark.operators.boosting import TreeParams
from rarespark.plans import reports
from rarespark.plans.experiment import Protocol, run, write_outputs
from rarespark.sources.tables import header_schema, load_transactions, read_table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    base = spark.range(0, 1500).select(
        F.col("id").alias("TransactionID"), ((F.xxhash64("id") % 8 == 0) & (F.col("id") % 3 == 0)).cast("int").alias("isFraud"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 13).alias("card1"), (F.col("id") % 3).cast("string").alias("ProductCD"),
        F.when(F.col("id") % 11 > 0, F.rand(3)).alias("amount"),
    )
    side = base.where("TransactionID % 3 = 0").select("TransactionID", F.lit("mobile").alias("DeviceType"), F.rand(4).alias("id_01"))
    base.coalesce(1).write.option("header", True).csv(f"{root}/train_transaction.csv")
    side.coalesce(1).write.option("header", True).csv(f"{root}/train_identity.csv")
    return root


TYPES = {"TransactionID": "bigint", "isFraud": "int", "card1": "bigint", "ProductCD": "string", "DeviceType": "string"}


def load(spark, folder):
    schemas = [header_schema(spark, folder, t, TYPES) for t in ("train_transaction", "train_identity")]
    return load_transactions(spark, folder, *schemas)


def test_load_joins_and_keeps_every_transaction(spark, folder):
    df = load(spark, folder)
    assert df.count() == 1500 and df.where("DeviceType is not null").count() == 500
    assert dict(df.dtypes)["card1"] == "bigint" and dict(df.dtypes)["amount"] == "double"


def test_missing_table_is_named(spark, folder):
    with pytest.raises(FileNotFoundError, match="other"):
        read_table(spark, folder, "other", "a int")
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, folder, "train_identity")


def test_bad_input_is_refused(spark, folder, tmp_path):
    df = load(spark, folder)
    twice = df.select("TransactionID", "isFraud").unionByName(df.select("TransactionID", "isFraud").limit(1))
    twice.write.option("header", True).csv(f"{tmp_path}/facts.csv")
    df.select("TransactionID").write.option("header", True).csv(f"{tmp_path}/sides.csv")
    with pytest.raises(ValueError, match="duplicate"):
        load_transactions(spark, str(tmp_path), "TransactionID bigint, isFraud int", "TransactionID bigint", fact="facts", side="sides")


def test_whole_run(spark, folder, tmp_path):
    trees = TreeParams(n_estimators=3, learning_rate=0.2, num_leaves=4, min_child_samples=5)
    protocol = Protocol(
        trees=trees, sensitivity_estimators=2, latent_dims=[2], rates=[0.1, 0.2], trials=1, autoencoder={"epochs": 1}
    )
    outcome = run(load(spark, folder), protocol)
    assert outcome.prepared.columns == ["card1", "ProductCD", "DeviceType", "amount", "id_01"]
    assert [r["scenario"] for r in outcome.metrics.orderBy("position").collect()] == reports.SCENARIO_NAMES
    assert outcome.deltas.count() == 4 and outcome.sensitivity.count() == 2
    assert outcome.thresholds.where("selected").count() == 6
    chosen = {r["scenario"]: r["threshold"] for r in outcome.thresholds.where("selected").collect()}
    assert chosen == {r["scenario"]: r["threshold"] for r in outcome.metrics.collect()}
    best = outcome.locked.first()["average_precision"]
    assert best == max(r["average_precision"] for r in outcome.sensitivity.collect())
    write_outputs(outcome, str(tmp_path / "out"))
    wide = spark.read.option("header", True).csv(f"{tmp_path}/out/test_scores")
    assert wide.columns == ["TransactionID", "isFraud", *reports.SCENARIO_NAMES]
    assert wide.count() == outcome.prepared.part("test").count()
    document = json.loads(spark.read.text(f"{tmp_path}/out/final_oversampling_results").first()[0])
    assert len(document["results"]) == 6 and len(document["split_summary"]) == 3
    assert document["locked"]["rate"] in (0.1, 0.2) and document["config"]["seed"] == 42 and document["config"]["rate_grid"] == [0.1, 0.2]
    table = spark.read.option("header", True).csv(f"{tmp_path}/out/metrics_table")
    assert {"scenario", "pr_auc", "roc_auc", "recall", "precision", "f1", "threshold"} <= set(table.columns)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/sensitivity_analysis").columns == ["latent_dim", "rate", "val_pr_auc"]
    assert reports.named_cells(outcome.sensitivity, short=False).columns == [
        "latent_dim", "target_fraud_rate", "n_synthetic", "validation_average_precision", "best_iteration"]
    tuned = {r["scenario"]: r for r in outcome.training_info.collect()}
    assert json.loads(tuned["baseline_tuned"]["best_params"]) and json.loads(tuned["baseline"]["best_params"]) == {}


DIRTY = [
    'TransactionID,isFraud,name,"amount, net",card1,note,hole',
    '1,0,"a ""quoted"" name",1.5,13926,x,',
    "2,1,NA,NaN,,null,",
    '3,0," spaced",-1e3,7,"with, comma",NA',
    "4,1,é,n/a,150,1.0d,",
]


@pytest.fixture()
def dirty(tmp_path):
    (tmp_path / "dirty.csv").write_text("\n".join(DIRTY) + "\n")
    return str(tmp_path)


def test_types_are_found_and_text_is_kept(spark, dirty):
    df = read_table(spark, dirty, "dirty", header_schema(spark, dirty, "dirty"))
    assert dict(df.dtypes) == {
        "TransactionID": "bigint", "isFraud": "bigint", "name": "string", "amount, net": "double", "card1": "string", "note": "string", "hole": "double"
    }
    rows = [tuple(r) for r in df.orderBy("TransactionID").collect()]
    assert rows == [
        (1, 0, 'a "quoted" name', 1.5, "13926", "x", None), (2, 1, None, None, None, None, None),
        (3, 0, " spaced", -1000.0, "7", "with, comma", None), (4, 1, "é", None, "150", "1.0d", None),
    ]


def test_lost_values_are_an_error(spark, dirty):
    schema = header_schema(spark, dirty, "dirty", {"note": "double"})
    with pytest.raises(ValueError, match="note"):
        read_table(spark, dirty, "dirty", schema)


def test_key_and_target_are_checked_on_the_main_path(spark, folder):
    df = load(spark, folder)
    with pytest.raises(ValueError, match="duplicate"):
        run(df.unionByName(df.limit(1)))
    with pytest.raises(ValueError, match="target"):
        run(df.withColumn("isFraud", F.when(F.col("TransactionID") > 5, F.col("isFraud"))))
