"""Token splitting and the register of workspaces."""

import os

import pytest
from pyspark.sql import functions as F

from lodewell.operators import tokens, workspaces

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_fallback_without_encoder(spark):
    assert tokens.split("x" * 3584, 1024, 128) == ["x" * 3584] and [len(p) for p in tokens.split("x" * 4000, 1024, 128)] == [4000, 416]
    assert tokens.split("", 5, 1) == tokens.split("abc", 0, 1) == [] and tokens.truncate("abcdefgh", 1) == "abcd" and tokens.truncate("a", 0) == ""
    df = spark.createDataFrame([("abcde",), (None,)], "t string")
    assert [r["n"] for r in df.select(tokens.count_tokens(F.col("t"), "/missing").alias("n")).collect()] == [2, None]


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
def test_encoder_windows(spark):
    e, text = tokens.encoder(PATH), "one two three four five six seven eight nine ten"
    parts = tokens.split(text, 4, 1, PATH)
    assert parts[0] == tokens.truncate(text, 4, PATH) and all(len(e.encode_ordinary(p)) <= 4 for p in parts)
    assert tokens.split("one", 4, 1, PATH) == ["one"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    assert tokens.split_documents(df, 4, 1, PATH).count() == len(parts)
    assert [r["n"] for r in df.orderBy("doc_id").select(tokens.count_tokens(F.col("text"), PATH).alias("n")).collect()] == [len(e.encode_ordinary(text)), None, 0]


def test_register_and_remove(spark, tmp_path):
    w = spark.createDataFrame([("app", "App", "/a"), ("app-2", "App (2)", "/b")], "workspace_id string, name string, root_path string")
    more = workspaces.register(w, "app", "App", "/c")
    assert more.filter("root_path = '/c'").first()["workspace_id"] == "app-3" and workspaces.register(w, "x", "X", "/a").count() == 2
    (tmp_path / "d").mkdir()
    left, report = workspaces.remove(spark, more, "app-3", str(tmp_path / "d"))
    assert report.deleted and report.unregistered and left.count() == 2 and not (tmp_path / "d").exists()
    assert workspaces.remove(spark, w, "app", str(tmp_path / "none"))[1].missing


def test_settings_and_retries():
    assert workspaces.resolve({"a": "", "b": "1"}, {"a": "2"}, {"a": "0", "b": "0", "c": "3"}) == {"a": "2", "b": "1", "c": "3"}
    seen, pauses = [], []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise RuntimeError("HTTP 503")
        return "ok"

    assert workspaces.retried(call, sleep=pauses.append) == "ok" and pauses == [1.0, 2.0]
    with pytest.raises(ValueError):
        workspaces.retried(lambda: (_ for _ in ()).throw(ValueError("bad key")), sleep=pauses.append)
