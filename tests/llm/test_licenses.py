import random
import re

import pytest
from pyspark.sql import functions as F

from molaris.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return WORD.findall(small(text or ""))


def ends(nodes, words, at):
    """Every place that a sequence of regions may end at, by trying all ways."""
    if not nodes:
        return {at}
    node, rest = nodes[0], nodes[1:]
    if node[0] == "word":
        return ends(rest, words, at + 1) if at < len(words) and words[at].encode() == node[1] else set()
    if node[0] == "any":
        after = {at + n for n in range(node[1], node[2] + 1) if at + n <= len(words)}
    elif node[0] == "optional":
        after = {at} | ends(node[1], words, at)
    else:
        after = set().union(*[ends(x, words, at) for x in node[1]])
    return set().union(*[ends(rest, words, x) for x in after])


def plain(text, templates=licenses.TEMPLATES):
    """(label, start, length) of every place from which a template can be read, by its shortest reading."""
    words = words_of(text)
    out = set()
    for label, markup in templates:
        nodes = licenses.parsed(markup)
        for i in range(len(words)):
            found = ends(nodes, words, i)
            if found:
                out.add((i, min(found) - i, label))
    return sorted(out)


def matches(result):
    return [(m["start"], m["length"], m["label"]) for m in result["matches"]]


SMALL = (
    ("one", '<<var;words="0-3">>grant <<beginOptional>>of <<beginOptional>>full<<endOptional>> right<<endOptional>> to <<var;words="1-2">> free'),
    ("two", '<<var;match="grant of|grant">> free <<var;match="use|use and copy">> <<beginOptional>>end<<endOptional>>'),
    ("three", 'to <<var;words="0-2">> to free to'),
)


def test_automata_equal_brute_force():
    one = licenses.Scanner(SMALL, ())
    rnd = random.Random(3)
    hits = 0
    for _ in range(6000):
        text = " ".join(rnd.choice(["grant", "of", "full", "right", "to", "free", "use", "and", "copy"]) for _ in range(rnd.randint(0, 40)))
        got = matches(one.scan(text.encode()))
        assert got == plain(text, SMALL), text
        hits += len(got)
    assert hits > 300


def test_whole_licenses():
    one = licenses.scanner(licenses.TEMPLATES, licenses.PHRASES)
    for label, markup in licenses.TEMPLATES:
        bare = re.sub(r"<<(begin|end)Optional>>", " ", markup)
        text = re.sub(r'<<var;[^>]*?(?:match="([^"|]*)[^"]*"|words="1-30")>>', lambda m: m.group(1) or "Some Holder, Inc.", bare)
        text = re.sub(r"<<var.*?>>", "*", text)
        found = one.scan(f"Before it. {text} After it.".encode())
        assert label in {m["label"] for m in found["matches"]} and found["score"] == 1.0
        words = text.split()
        # one mandatory word changed in the middle
        k = len(words) // 2
        while not re.fullmatch(r"[A-Za-z]{5,}", words[k]):
            k -= 1
        less = one.scan(" ".join([*words[:k], "otherwise", *words[k + 1:]]).encode())
        if len(words) > 20:
            assert not less["matches"] and 0 < less["score"] < 1


def test_markup_errors():
    for markup in ("a <<beginOptional>> b", "<<endOptional>> a", "<<beginOptional>>a<<endOptional>>", "a <<var;name=\"x\">> b", "a <<alt>> b"):
        with pytest.raises(licenses.TemplateError):
            licenses.Automaton(markup)


def expected(text):
    words = words_of(text)
    joined = " " + " ".join(words) + " "
    places = []
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(own)] == own]
    base = {label for _, label in places}
    added = {m[2] for m in plain(text)} if re.search(r" licen|permission|redistribution|provided", joined) else set()
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | added)))


def test_op13(spark, sf, texts):
    answer = queries.op13_license_scan(spark, sf).collect()
    assert len(answer) == len(texts)
    for r in answer:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        assert got == expected(texts[r.doc_id]) and 0 <= r.score <= 1
    assert any(r.labels != r.base_labels for r in answer)


def test_odd_rows(spark, odd, none):
    df, out = licenses.found(odd.withColumn("licenses", F.lit("mine")))
    assert out == "licenses_"
    for r in df.collect():
        assert r["licenses"] == "mine" and r[out].n_words == len(words_of(r["text"])) and r[out].score == 0
        assert r[out].mentions == [] and r[out].matches == []
    assert licenses.found(none)[0].count() == 0
    rows = [(1, "CC-BY cc by. CC by"), (None, "Under the MIT\x00License; released under the terms of the MIT license" + " x" * 50_000),
            (1, "CC-BY cc by. CC by"), (2, "İ MİT license ſ")]
    got = {(r.doc_id or 0): r.licenses for r in licenses.found(spark.createDataFrame(rows, "doc_id bigint, text string"))[0].collect()}
    assert [m.start for m in got[1].mentions] == [0, 2, 4] and got[1].score == licenses.MENTIONED
    assert [m.start for m in got[0].mentions] == [2, 10] and [tuple(m) for m in got[0].matches] == [("mit", 4, 8)] and got[0].n_words == 50_012
    assert got[2].mentions == []
