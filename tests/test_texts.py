"""Dictionaries, trie and suffix array against naive answers."""

import random

import pytest

from seqlytics.operators import suffix, textdict, trie

BASIC = ["apple", "application", "banana", "hana"]


def dictionary(spark, strings, kind="string", **options):
    rows = [(i, bytearray(s) if isinstance(s, bytes) else s) for i, s in enumerate(strings)]
    return textdict.TextDictionary(spark.createDataFrame(rows, f"id long, s {kind}"), **options)


def ids(df):
    return [r["id"] for r in df.collect()]


def counts(df):
    return [(r["id"], r["occurrences"]) for r in df.collect()]


def test_basic(spark):
    d = dictionary(spark, BASIC)
    assert ids(d.find_prefix("app")) == [0, 1] and ids(d.find_suffix("ana")) == [2, 3] and ids(d.find_substring("ana")) == [2, 3]
    assert counts(d.find_substring_occurrences("ana")) == [(2, 2), (3, 1)]
    assert d.find_exact("banana") == 2 and d.find_exact("ban") is None and d.contains("hana")
    assert d.restore(1) == "application" and len(d) == 4
    with pytest.raises(IndexError):
        d.restore(4)


def test_empty_strings_and_patterns(spark):
    assert ids(dictionary(spark, []).find_substring("")) == []
    d = dictionary(spark, ["", "a"])
    assert d.find_exact("") == 0 and counts(d.find_substring_occurrences("")) == [(0, 1), (1, 2)]
    assert ids(d.find_prefix("")) == ids(d.find_suffix("")) == ids(d.find_substring("")) == [0, 1]


def test_overlaps(spark):
    assert counts(dictionary(spark, ["aaaaa", "aaa", "baaaab"]).find_substring_occurrences("aaa")) == [(0, 3), (1, 1), (2, 2)]
    assert counts(dictionary(spark, ["a" * 1000, "a" * 500 + "b"]).find_substring_occurrences("aaa")) == [(0, 998), (1, 498)]


def test_bytes(spark):
    assert ids(dictionary(spark, ["東京", "東京都", "京都", "大阪"]).find_substring("京都")) == [1, 2]
    binary = dictionary(spark, [bytes(range(256)) + b"\0\1", b"\0\1"], "binary")
    assert ids(binary.find_substring(b"\0\1")) == [0, 1] and counts(binary.find_substring_occurrences(b"\0\1")) == [(0, 2), (1, 1)]
    assert ids(binary.find_prefix(b"\0\1\2")) == [0] and ids(binary.find_suffix(b"\xff\0\1")) == [0]
    assert ids(dictionary(spark, ["é", "è"]).find_substring(b"\xa9")) == [0]


def test_duplicates(spark):
    with pytest.raises(ValueError):
        dictionary(spark, ["a", "b", "a"])
    d = dictionary(spark, ["a", "b", "a"], distinct=False)
    assert d.find_exact("a") == 0 and ids(d.find_substring("a")) == [0, 2] and ids(d.find_prefix_trie_order("a")) == [0]
    assert [tuple(r) for r in textdict.duplicates(d.rows).collect()] == [("a", 2, 0)]


def test_random_dictionaries(spark):
    rng = random.Random(5)
    strings = list({"".join(rng.choice("abcdefgh"[:3]) for _ in range(rng.randrange(20))) for _ in range(25)})
    d = dictionary(spark, strings)
    for _ in range(6):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
        assert ids(d.find_prefix(p)) == [i for i, s in enumerate(strings) if s.startswith(p)]
        assert ids(d.find_suffix(p)) == [i for i, s in enumerate(strings) if s.endswith(p)]
        want = [(i, sum(s.startswith(p, k) for k in range(len(s)))) for i, s in enumerate(strings) if p in s]
        assert counts(d.find_substring_occurrences(p)) == want
        assert [strings[i] for i in ids(d.find_prefix_trie_order(p))] == sorted(s for s in strings if s.startswith(p))


def test_trie_shape(spark):
    strings = ["application", "applicable", "applicant", "apple"]
    nodes = trie.trie_nodes(spark.createDataFrame(list(enumerate(strings)), "id long, s string"))
    stats = trie.trie_stats(nodes).first()
    assert (stats["edge_count"], stats["longest_label"], stats["terminal_count"], stats["internal_count"]) == (6, 4, 4, 4 - 1)
    prefixes = sorted(bytes.fromhex(r["prefix"]).decode() for r in nodes.collect())
    assert prefixes == sorted(["", "appl", "applica", *strings])
    children = {(bytes.fromhex(r["parent"]).decode(), bytes.fromhex(r["first_byte"]).decode()) for r in trie.child_of(nodes).collect()}
    assert children == {("", "a"), ("appl", "i"), ("appl", "e"), ("applica", "t"), ("applica", "b"), ("applica", "n")}
    assert trie.order_correlation(nodes).first()[0] == pytest.approx(-0.8)  # in byte order the ids are 3, 1, 2, 0


def naive_trie(strings):
    """(prefix, parent, depth, label bytes, children) of every node, by plain prefixes."""
    raw = sorted({s.encode() for s in strings})
    nodes = {b"", *raw}
    for a, b in zip(raw, raw[1:], strict=False):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        nodes.add(a[:k])
    parent = {n: max((m for m in nodes if m != n and n.startswith(m)), key=len, default=None) for n in nodes}
    depth = {n: sum(m != n and n.startswith(m) for m in nodes) for n in nodes}
    return sorted((n.hex().upper(), None if parent[n] is None else parent[n].hex().upper(), depth[n], len(n) - len(parent[n] or b""), sum(p == n for p in parent.values())) for n in nodes)


@pytest.mark.parametrize("strings", [[], [""], ["a"], ["", "a", "ab", "abc", "abcd", "abcde", "b"], ["é", "è", "e", "東京", "東京都", "x" * 4000, "x" * 3999 + "y"]])
def test_tries_equal_naive_ones(spark, strings):
    nodes = trie.trie_nodes(spark.createDataFrame(list(enumerate(strings)), "id long, s string"))
    rows = nodes.orderBy("node").collect()
    assert [(r["prefix"], r["parent"], r["depth"], r["label_bytes"], r["children"]) for r in rows] == sorted(naive_trie(strings), key=lambda x: x[0])
    assert [r["node"] for r in rows] == list(range(len(rows)))


def test_trie_navigation_and_bytes(spark):
    strings = ["application", "applicable", "applicant", "apple"]
    nodes = trie.trie_nodes(spark.createDataFrame(list(enumerate(strings)), "id long, s string")).cache()
    rows = nodes.orderBy("node").collect()
    offsets = {r["node"]: r["first_child"] for r in trie.child_offsets(nodes).collect()}
    at = 0
    for r in rows:
        assert offsets[r["node"]] == (at if r["children"] else -1)
        at += r["children"]
    ranges = {r["node"]: (r["first"], r["past"]) for r in trie.suffix_ranges(nodes).collect()}
    assert sum(b - a for a, b in ranges.values()) == sum(max(0, r["label_bytes"] - 1) for r in rows)
    widths = trie.parent_widths(nodes).collect()
    assert [(r["block"], r["width"], r["words"]) for r in widths] == [(0, 2, 1)]
    used = textdict.TextDictionary(nodes.where("terminal_id IS NOT NULL").selectExpr("terminal_id AS id", "decode(unhex(prefix), 'UTF-8') AS s")).memory_usage()
    assert used["total"] == used["trie"] + used["fm_total"] and used["trie"] > 0
    with pytest.raises(ValueError):
        suffix.decode_byte(suffix.SEPARATOR)
    assert [suffix.decode_byte(suffix.encode_byte(b)) for b in (0, 65, 255)] == [0, 65, 255]


def test_equal_strings_by_what_follows(spark):
    """Of equal strings the text index finds the one whose following text is smallest."""
    strings = ["b", "x", "b", "a", "b", "x", "c"]
    d = dictionary(spark, strings, distinct=False)
    text = naive_text(strings)
    start = [i for i, s in enumerate(text) if s == suffix.SEPARATOR]
    for s in ("b", "x", "a"):
        want = min((i for i, t in enumerate(strings) if t == s), key=lambda i: text[start[i] :])
        assert d.find_exact_fm(s) == want
    assert d.find_exact_fm("zz") is None and d.find_exact("b") == 0
    asked = spark.createDataFrame([("b",), ("q",)], "s string")
    assert {r["s"]: r["id"] for r in d.find_exact_batch(asked).collect()} == {"b": 0, "q": None}


def naive_text(strings):
    out = []
    for s in strings:
        out += [suffix.SEPARATOR, *(b + 1 for b in s.encode())]
    return [*out, suffix.SEPARATOR, suffix.END]


@pytest.mark.parametrize("strings", [["apple", "application", "banana", "hana"], ["aaaa", "aa", ""], ["é", "ab"]])
def test_suffix_array_and_bwt(spark, strings):
    rows = spark.createDataFrame(list(enumerate(strings)), "id long, s string")
    text = suffix.text_symbols(rows)
    want = naive_text(strings)
    assert [r["sym"] for r in text.orderBy("pos").collect()] == want
    array = suffix.suffix_array(text)
    order = sorted(range(len(want)), key=lambda i: want[i:])
    assert [r["pos"] for r in array.orderBy("row").collect()] == order
    transformed = suffix.bwt(text, array)
    last = [want[i - 1] for i in order]
    assert [r["sym"] for r in transformed.orderBy("row").collect()] == last
    jumps = {r["row"]: r["lf"] for r in suffix.last_to_first(transformed).collect()}
    assert all(order[jumps[row]] == (order[row] - 1) % len(want) for row in jumps)


def test_known_transform_and_search(spark):
    rows = spark.createDataFrame(list(enumerate(["apple", "application", "banana", "hana"])), "id long, s string")
    text = suffix.text_symbols(rows)
    transformed = suffix.bwt(text, suffix.suffix_array(text)).cache()
    shown = "".join({suffix.SEPARATOR: "%", suffix.END: "$"}.get(r["sym"], chr(max(0, r["sym"] - 1))) for r in transformed.orderBy("row").collect())
    assert sorted(shown) == sorted("%apple%application%banana%hana%$")
    for pattern, n in ((b"ana", 3), (b"app", 2), (b"x", 0), (b"banana", 1)):
        left, right = suffix.backward_search(transformed, pattern)
        assert right - left == n
