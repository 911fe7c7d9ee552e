"""Payloads that begin like JSON and go on."""

from gneiss.sources.payloads import payload_text


def test_what_follows_a_value_is_no_json(spark):
    good = '{"content":"t"}'
    wrong = ["5 words", '"x" y', "null null", "[1] z", good + " tail", good + good, good + "," + good, "1],[2", "1],2] x", "1]]", "", " ", None, '{"a":1', "[1", '1],"x"]']
    rows = [(i, p) for i, p in enumerate([*wrong, good, f" {good} ", "[1]", "5", "null", '"x"'])]
    got = {r.i: (r.text, r.error) for r in payload_text(spark.createDataFrame(rows, "i int, payload string")).collect()}
    n = len(wrong)
    assert {i: got[i] for i in range(n)} == {i: (None, "not JSON") for i in range(n)}
    assert [got[i] for i in range(n, n + 6)] == [("t", None), ("t", None)] + [(None, "not an object")] * 4
