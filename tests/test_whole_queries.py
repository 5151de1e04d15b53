"""Queries give their operators the whole of the data and of the training."""

from pyspark.sql import functions as F
from strandwork.constants import EM_ROUNDS
from strandwork.operators import hmm
from strandwork.plans import model, samples


def test_kmeans_sees_every_dimension(spark, tmp_path):
    """Vectors that differ in their last dimension alone fall into different clusters."""
    vectors = spark.range(40).select(
        F.col("id").alias("vec_id"), F.concat(F.array_repeat(F.lit(1.0), 63), F.array(F.col("id") / 40)).alias("embedding")
    )
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: r["occ_cluster"] for r in samples.kmeans_clusters(spark, str(tmp_path)).collect()}
    assert len(found) == 40 and len(set(found.values())) > 1


def test_hmm_trains_all_rounds(spark, data, monkeypatch):
    asked = []

    def train(segments, start, rounds=EM_ROUNDS, cap=None):
        asked.append(rounds)
        return start, [0.0]

    monkeypatch.setattr(hmm, "train", train)
    model.hmm_train(spark, data)
    assert asked == [EM_ROUNDS]
