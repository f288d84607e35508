import json

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.functions.jsonindex import is_valid
from ledgerlake.operators.nested import DocumentRows, flatten_documents


def walk(text):
    """Plain reading of a document: the entries of every taxonomy, tag and unit."""
    doc = json.loads(text)
    out = []
    facts = doc.get("facts") if isinstance(doc, dict) else None
    for tax, tags in (facts if isinstance(facts, dict) else {}).items():
        for tag, body in (tags if isinstance(tags, dict) else {}).items():
            units = body.get("units") if isinstance(body, dict) else None
            for unit, entries in (units if isinstance(units, dict) else {}).items():
                for i, e in enumerate(entries if isinstance(entries, list) else [entries]):
                    if isinstance(e, dict):
                        out.append((tax, tag, unit, i, e.get("accn") if isinstance(e.get("accn"), str) else None))
    return sorted(out, key=repr)


def indexed(text):
    return sorted(((*e[:4], e[4].get("accn")) for e in DocumentRows(text).entries), key=repr)


names = st.sampled_from(["us-gaap", "dei", "Tag", 'q"uote', "b\\slash", "units", "facts", "ünï", "a{b", "x]y", "", "accn", ":,"])
scalar = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), names, st.floats(allow_nan=False, allow_infinity=False))
entry = st.one_of(st.dictionaries(st.sampled_from(["accn", "val", "end", "fy"]), st.one_of(names, st.none(), st.lists(scalar, max_size=2), st.dictionaries(names, scalar, max_size=2)), max_size=4), scalar, st.lists(scalar, max_size=2))
unit = st.one_of(st.lists(entry, max_size=4), entry)
tag = st.one_of(st.dictionaries(st.sampled_from(["units", "label", "description"]), st.one_of(st.dictionaries(names, unit, max_size=3), scalar, st.lists(scalar)), max_size=3), scalar)
taxonomy = st.one_of(st.dictionaries(names, tag, max_size=3), scalar, st.lists(tag, max_size=2))
document = st.dictionaries(st.sampled_from(["facts", "cik", "entityName", "x"]), st.one_of(st.dictionaries(names, taxonomy, max_size=3), scalar, st.lists(scalar, max_size=2)), max_size=4)


@given(document, st.sampled_from([None, 1]), st.booleans())
@settings(max_examples=400, deadline=None)
def test_index_finds_what_a_tree_walk_finds(doc, indent, ascii_only):
    # entries whose accn is a string: others are compared as absent
    text = json.dumps(doc, indent=indent, ensure_ascii=ascii_only)
    got = [(*e[:4], e[4]) if isinstance(e[4], str) else e for e in indexed(text)]
    want = walk(text)
    assert [g[:4] for g in got] == [w[:4] for w in want]


def test_values_escapes_and_repeated_names():
    text = '{"facts":{"t":{"A":{"label":"say \\"x\\": [1,{","units":{"USD":[null,{"accn":"1","val":1.50,"fp":null},7,{"val":"a\\u00e9"}]}},"A":{"units":{"EUR":{"accn":"z"}}}}},"cik":12,"entityName":"N"}'
    d = DocumentRows(text)
    assert d.cover == {"cik": "12", "entityName": "N"}
    assert d.entries == [["t", "A", "EUR", 0, {"accn": "z"}]]  # the last of two members A
    one = text.replace(',"A":{"units":{"EUR":{"accn":"z"}}}', "")
    assert DocumentRows(one).entries == [["t", "A", "USD", 1, {"accn": "1", "val": "1.50"}], ["t", "A", "USD", 3, {"val": "aé"}]]
    assert DocumentRows(one).tags == [["t", "A", 'say "x": [1,{', None, 1]]


def test_validity():
    assert is_valid(' {"a": [1, 2e3, "\\u0041"]} ') and is_valid("null") and is_valid("3")
    assert not any(map(is_valid, ["", "{", '{"a":NaN}', '{"a":1,}', "{'a':1}", '{"a":1} x', '{"a":"']))


def test_tables_link_and_bad_rows_do_not_crash(spark):
    good = '{"facts":{"us-gaap":{"A":{"units":{"USD":[{"accn":"1"}]}}}},"entityName":"N"}'
    rows = [(good, "2020-01-01", "1", 5), (good, "2020-01-01", "1", 5), (None, None, None, 5), ("", "d", "2", 5), ('{"facts":', "d", "3", 5), ("[1]", "d", "4", 5), ('"x"', "d", "5", 5)]
    df = spark.createDataFrame(rows, "json_text string, extract_date string, cik string, doc_key int")
    docs, tags, entries = (flatten_documents(df.drop("doc_key"), k) for k in ("documents", "tags", "entries"))
    assert docs.count() == 7 and docs.where("is_valid").count() == 4
    assert entries.distinct().count() == 1 and tags.distinct().count() == 1
    assert entries.join(tags.distinct(), ["doc_key", "taxonomy", "concept_name"]).join(docs.distinct(), "doc_key").count() == 2
    assert flatten_documents(df.where("false"), "entries").count() == 0


def test_a_very_long_document():
    text = json.dumps({"facts": {"t": {f"T{i}": {"units": {"USD": [{"accn": str(j)} for j in range(50)]}} for i in range(400)}}})
    assert len(DocumentRows(text).entries) == 20_000


def by_parser(text):
    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
    except ValueError:
        return False
    return True


@given(st.text(alphabet='{}[]:,"\\ \n0123e-+.ntfalsru\x01é', max_size=14))
@settings(max_examples=3000, deadline=None)
def test_validity_is_the_parsers(text):
    assert is_valid(text) == by_parser(text)


@given(document, st.data())
@settings(max_examples=400, deadline=None)
def test_validity_of_damaged_documents(doc, data):
    text = json.dumps(doc)
    at = data.draw(st.integers(0, len(text)))
    text = text[:at] + data.draw(st.sampled_from(["", ",", "]", "}", '"', "\\", ":", "1", "[", "null "])) + text[at + data.draw(st.integers(0, 2)) :]
    assert is_valid(text) == by_parser(text)


def test_another_shape_of_document(spark):
    from ledgerlake.operators.nested import Table, flatten_nested

    shop = {"orders": [{"id": 7, "lines": [{"sku": "a", "tags": {"x": {"w": 1}, "y": {"w": 2}}}, None, {"sku": "b"}]}, {"id": 8, "lines": {"sku": "c", "tags": {"z": {"w": None}}}}, 5]}
    df = spark.createDataFrame([(1, json.dumps(shop)), (2, "[]"), (3, "{"), (4, None)], "text int, body string")
    orders = Table((("orders", None), ("[]", "order_no")), {"id": "id"}, {"n_lines": ("lines", False)})
    lines = Table((*orders.path, ("lines", None), ("[]", "line_no")), {"sku": "sku"})
    tags = Table((*lines.path, ("tags", None), ("*", "tag")), {"weight": "w"})
    rows = lambda t: sorted(map(tuple, flatten_nested(df, t, "body", ["text"]).collect()), key=repr)
    assert rows(orders) == [(1, 0, "7", 2), (1, 1, "8", 2)]
    assert rows(lines) == [(1, 0, 0, "a"), (1, 0, 2, "b"), (1, 1, 0, "c")]
    assert rows(tags) == [(1, 0, 0, "x", "1"), (1, 0, 0, "y", "2"), (1, 1, 0, "z", None)]


@given(st.lists(st.one_of(document.map(json.dumps), st.sampled_from(["", "{}", "[]", "[1", "2]", '{"a":1},{"b":2}', '{"a":1', "}", "3", '"x"', " {} ", "[1],[2]", "{}]", "[{}", '{"facts":{"t":{"A":{"units":{"U":[{"accn":"1"}]}}}}}'])), max_size=9))
@settings(max_examples=400, deadline=None)
def test_documents_indexed_together_give_the_same(texts):
    import pandas as pd

    from ledgerlake.operators.nested import _TEXT, FILING_TABLES, _flatten

    for kind, invalid in (("entries", False), ("tags", False), ("documents", True)):
        run = _flatten(FILING_TABLES[kind], ["k"], invalid, None)
        rows = lambda parts: sorted((repr(tuple(r)) for f in run(iter(parts)) for r in f.astype(object).itertuples(index=False)))
        whole = pd.DataFrame({"k": [str(i) for i in range(len(texts))], _TEXT: pd.Series(texts, dtype=object)})
        single = [whole.iloc[i : i + 1] for i in range(len(texts))]
        assert rows([whole]) == rows(single)
    if texts:
        frames = list(_flatten(FILING_TABLES["documents"], ["k"], True, None)(iter([whole])))
        assert {r.k: r.is_valid for f in frames for r in f.itertuples()} == {str(i): by_parser(t) for i, t in enumerate(texts)}


def test_memory_of_long_documents_is_flat():
    import resource

    from ledgerlake.operators.nested import _TEXT, FILING_TABLES, _flatten

    text = json.dumps({"facts": {"t": {f"T{i}": {"units": {"USD": [{"accn": f"{j:020d}", "val": j, "end": "2020-01-01"} for j in range(50)]}} for i in range(1200)}}})
    assert len(text) > 3_700_000
    import pandas as pd

    run = _flatten(FILING_TABLES["entries"], ["k"], False, None)
    rows, seen = 0, []
    for frame in run(pd.DataFrame({"k": ["a"], _TEXT: [text]}) for _ in range(12)):
        rows += len(frame)
        seen.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
    assert rows == 12 * 60_000 and seen[-1] - seen[1] < 60_000, seen  # KB


def test_long_numbers_and_deep_brackets_are_json():
    import random

    deep = "[" * 100_000 + "]" * 100_000
    body = '"units":{"USD":[{"accn":"a1","val":%s}]}'
    for value in ("9" * 5_000, deep, '{"a":' * 50_000 + "1" + "}" * 50_000):
        text = '{"facts":{"us-gaap":{"T":{' + body % value + "}}}}"
        assert is_valid(text)
        assert [(*e[:4], e[4]["accn"]) for e in DocumentRows(text).entries] == [("us-gaap", "T", "USD", 0, "a1")]
    for bad in (deep[:-1], deep + "]", deep[:-1] + "}", "[" * 100_000 + "1,]" + "]" * 99_999, deep + " 1"):
        assert not is_valid(bad)
    rnd = random.Random(3)
    base = '{"a": [1, -2.5e+3, "x\\u00e9\\n", {"b": null, "c": []}, true], "d": {}}'
    for _ in range(3000):
        t = list(base)
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(t))
            t[i] = rnd.choice(["", rnd.choice('{}[],:"\\0e-. \x01\n'), t[i] * 2])
        t = "".join(t)
        assert is_valid(t) == by_parser(t), t
    assert not any(map(is_valid, ("", " ", "01", "NaN", "-", "1 2", "{,}", "[1 2]", '{"a"}', "\ufeff1")))
