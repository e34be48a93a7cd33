import random

import pytest
from pyspark.sql import functions as F

from cachescope.functions import json_text as jt
from cachescope.operators import chunks as ck


def bodies(seed, n):
    rnd = random.Random(seed)
    letters = "ab é€😀\u2028\\n\"{}"
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randrange(14)):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(9))).replace("\\", "").replace('"', "")
            lines.append(rnd.choice([f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}', "", ": note", "data: [DONE]", "data: {", "\r",
                                     f'data: {{"choices":[{{"message":{{"content":"{text}"}}}},{{"delta":{{"content":"z"}}}}]}}  ',
                                     'data: {"choices":[{"delta":{"content":5}}]}']))
        rows.append((i, "\n".join(lines) + rnd.choice(["", "\n", "\n\n"])))
    return rows


@pytest.mark.parametrize("size,block", [(1, 3), (2, 7), (7, 2), (40, 4), (1024, 4096)])
def test_equals_the_text_of_the_whole_body(spark, size, block):
    df = spark.createDataFrame(bodies(size, 40) + [(100, None), (101, "")], "request_id long, body string").repartition(3)
    want = {r.request_id: r.text for r in df.select("request_id", jt.sse_text("body").alias("text")).collect()}
    cut = ck.chunked(df, "body", size=size)
    # numbers need not begin at 0, nor follow each other; a delivery may come twice
    cut = cut.unionByName(cut.where("number % 3 = 0")).withColumn("number", F.col("number") * 2 - 9).withColumn("text", F.lit(1))
    got = ck.stream_text(cut.repartition(4), block_chunks=block).collect()
    assert {r.request_id: r.text for r in got} == want and len(got) == len(want)
    assert any("😀" in t for t in want.values())


def test_defined_cases(spark):
    rows = [(None, 0, b'data: {"choices":[{"delta":{"content":"n'), (None, 1, b'ull"}}]}'), (1, None, b"data: x"), (2, 5, None),
            (3, 0, b'data: {"choices":[{"delta":{"content":"\xff"}}]}')]
    df = spark.createDataFrame(rows, "request_id long, number long, data binary")
    got = {r.request_id: r.text for r in ck.stream_text(df).collect()}
    assert got == {None: "null", 2: "", 3: "\ufffd"}
    assert ck.stream_text(df.where("false")).collect() == []
