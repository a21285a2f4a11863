import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascout.llm import arrays, groups, language_model


def test_an_array_that_is_missing_raises(tmp_path):
    arrays.write(str(tmp_path), 0, key=np.array([3, 7], dtype=np.uint64), n=np.array([1, 2]))
    assert arrays.gather(str(tmp_path), 1, np.array([3, 5], dtype=np.uint64), n=np.int64(0))["n"].tolist() == [1, 0]
    with pytest.raises(FileNotFoundError, match="spark.checkpoint.dir"):
        arrays.gather(str(tmp_path), 2, np.array([1 << 63], dtype=np.uint64), n=np.int64(0))


def test_scores_fail_where_the_model_is_not(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b c")], "doc_id long, text string")
    model = language_model.train(docs.select("text"), 8)
    assert language_model.score(docs, model, ["doc_id"]).count() == 2
    other = language_model.Model(**{**model.__dict__, "path": tempfile.mkdtemp(prefix="spark-")})
    with pytest.raises(Exception, match="spark.checkpoint.dir"):
        language_model.score(docs, other, ["doc_id"]).collect()


@pytest.mark.parametrize("parts", [1, 50])
def test_hot_keys_are_found_however_their_members_are_spread(spark, monkeypatch, parts):
    for block, members in ((100, 200), (1024, 4000)):
        monkeypatch.setattr(groups, "BLOCK", block)
        rows = [(h, int(5).to_bytes(8, "little") + int(h + 1000).to_bytes(8, "little")) for h in range(members)]
        found = groups.crowded(spark.createDataFrame(rows, "h long, prints binary").repartition(parts))
        got = {r.key: (r.n, r.pivot) for r in found.groupBy("key").agg(F.sum("n").alias("n"), F.min("pivot").alias("pivot")).collect()}
        assert members * 0.7 <= got[5][0] <= members * 1.3 and 0 <= got[5][1] < members
        assert max(n for k, (n, _) in got.items() if k != 5) <= block // 64 + 1
