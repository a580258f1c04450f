import json

from limnos.operators import settings


def flat(value, path=()):
    if isinstance(value, dict) and value:
        return {k: v for name, x in value.items() for k, v in flat(x, (*path, name)).items()}
    return {path: value} if path else {}


def merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def test_merge_matches_the_recursion(spark):
    base = [
        {"a": {"b": 1, "c": [1, {"d": 2}]}, "e": "x.y", "f": {}}, {"a": {"b": {"c": {"d": 1}}}}, {"a": 1}, {"a": {"b": 1}}, {"a": {}}, {"k.l": {"m": None}}, {}, {"a": {"b": 1}},
    ]
    over = [{"a": {"c": 5}, "e": {"z": 1}, "g": True}, {"a": {"b": {"c": 3, "x": {}}}}, {"a": {"b": 2}}, {"a": {}}, {"a": {"n": "ü"}}, {"k.l": {"m": {"o": 1.5}}, "k": {"l": 2}}, {"q": 1}, {}]
    rows = [(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(zip(base, over, strict=True))] + [(90, None, "[1]"), (91, " ", '"x"'), (92, '{"a": 1}', "no json")]
    texts = spark.createDataFrame(rows, "doc_id long, base string, over string")
    got = {}
    for r in settings.merged(settings.leaves(texts, "base"), settings.leaves(texts, "over")).collect():
        assert tuple(r.path) not in got.setdefault(r.doc_id, {})
        got[r.doc_id][tuple(r.path)] = json.loads(r.value)
    want = {k: flat(merge(a, b)) for k, (a, b) in enumerate(zip(base, over, strict=True))} | {92: {("a",): 1}}
    assert got == {k: v for k, v in want.items() if v}
