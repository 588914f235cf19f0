"""License scan: license texts and notices as templates with optional and replaceable regions.

A template is plain wording with markup. ``<<beginOptional>>...<<endOptional>>`` may be absent (and may be nested),
``<<var;match="a b|c">>`` stands for one of the given wordings, ``<<var;words="1-30">>`` for so many words of any
kind; other attributes (``name``, ``original``) are notes. All else is mandatory.

Method. Each template is compiled into an automaton over words. It starts wherever the first words that it can begin
with stand in a text (``ANCHOR`` words at most), reads on word by word, and accepts once all mandatory wording has been
read exactly, with nothing between but what its regions allow. Optional regions at either end of a template decide
nothing and are left out. Deterministic states are made when a text first needs them.

``mentions`` are places of fixed phrases, by their words alone. The score is the largest share of a template's
mandatory words that its automaton got through from one place: 1 for an accepted text. A phrase alone scores
``MENTIONED`` at least, a text without an anchor or phrase 0.

* Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and empty texts have none.
* Each row is judged by itself, so repeated rows, null ids and other columns change nothing; all columns stay.
* Several templates may accept at one place; each gives a match, which ends with its first acceptance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import free_name

ANCHOR = 3
MENTIONED = 0.5

RESULT = ("n_words bigint, mentions array<struct<label: string, start: bigint>>, "
          "matches array<struct<label: string, start: bigint, length: bigint>>, score double")

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_START = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<var;name="bullet";words="0-1">> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<var;name="bullet";words="0-1">> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";words="1-30">> "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";words="1-30">> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.
"""
_UNDER = """<<var;match="licensed|released|distributed|available|published">> under <<beginOptional>><<var;match="the terms of|terms of">>
<<endOptional>> <<var;match="the|a|an">> """
_WORK = """licensed under <<var;match="the|a">> Creative Commons """

#: The wording of public licenses and of usual notices.
TEMPLATES = (
    ("mit", f"""
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";words="1-30">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("isc", f"""
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS} AND
<<var;name="holder";original="THE AUTHOR";words="1-30">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHOR";words="1-30">> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", _BSD_START + _BSD_END),
    ("bsd-3-clause", _BSD_START + """
<<var;name="bullet";words="0-1">> Neither the name of <<var;name="holder";original="the copyright holder";words="1-30">> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_END),
    ("zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: <<var;name="bullet";words="0-1">> The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. <<var;name="bullet";words="0-1">> Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. <<var;name="bullet";words="0-1">> This notice may not be removed or altered
from any source distribution."""),
    ("mit", _UNDER + "MIT License"),
    ("apache-2.0", _UNDER + "Apache License<<beginOptional>>,<<endOptional>> <<var;match=\"version|v\">> 2.0"),
    ("gpl-2.0", _UNDER + "GNU General Public License <<var;match=\"version|v\">> 2"),
    ("gpl-3.0", _UNDER + "GNU General Public License <<var;match=\"version|v\">> 3"),
    ("gpl-3.0", """under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version"""),
    ("gpl-2.0", """under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
(at your option) any later version"""),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC-SA 4.0"),
    ("cc-by-4.0", _WORK + "Attribution 4.0 International License"),
    ("cc-by-sa-4.0", _WORK + "Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", _WORK + "Attribution-NonCommercial 4.0 International License"),
)

_PARTS = re.compile(r"<<(.*?)>>", re.DOTALL)
_ATTRIBUTE = re.compile(r';\s*(\w+)\s*=\s*"([^"]*)"')
# what separates words becomes a blank, A-Z become small
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Node = tuple  # ("word", w) | ("any", low, high) | ("choice", [sequence, ...]) | ("optional", sequence)


class TemplateError(ValueError):
    """Markup that cannot be read."""


def words_of(text: str | bytes) -> list[bytes]:
    raw = text.encode("utf-8") if isinstance(text, str) else text
    return raw.translate(_PLAIN).split()


def _literal(text: str) -> list[Node]:
    return [("word", w) for w in words_of(text)]


def _variable(body: str) -> Node:
    given = dict(_ATTRIBUTE.findall(body))
    if "match" in given:
        return "choice", [_literal(x) for x in given["match"].split("|")]
    low, _, high = given.get("words", "").partition("-")
    if not (low.isdigit() and high.isdigit() and int(low) <= int(high)):
        raise TemplateError(f"a variable needs match or words: {body}")
    return "any", int(low), int(high)


def parsed(markup: str) -> list[Node]:
    """The regions of a template in order, without those at its ends that may be absent."""
    open_: list[list[Node]] = [[]]
    for i, part in enumerate(_PARTS.split(markup)):
        if i % 2 == 0:
            open_[-1] += _literal(part)
        elif part == "beginOptional":
            open_.append([])
        elif part == "endOptional" and len(open_) > 1:
            inner = open_.pop()
            open_[-1].append(("optional", inner))
        elif part.startswith("var"):
            open_[-1].append(_variable(part))
        else:
            raise TemplateError(f"unknown markup: {part}")
    if len(open_) > 1:
        raise TemplateError("an optional region without an end")
    nodes = open_[0]
    loose = ("optional", "any")
    while nodes and nodes[0][0] in loose:
        nodes = nodes[1:]
    while nodes and nodes[-1][0] in loose:
        nodes = nodes[:-1]
    if not nodes:
        raise TemplateError("a template without mandatory wording")
    return nodes


class Automaton:
    """A template over words: states made of places between its words, steps found once and kept."""

    def __init__(self, markup: str) -> None:
        self._words: list[dict[bytes, int]] = []
        self._any: list[int | None] = []
        self._empty: list[list[int]] = []
        self._read: list[int] = []  # mandatory words before a place
        begin = self._place(0)
        self._end = self._sequence(parsed(markup), begin, mandatory=True)
        self.mandatory = self._read[self._end]
        self.start = self._closed([begin])
        self._steps: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        self._progress: dict[frozenset[int], int] = {}
        self._known = {w for edges in self._words for w in edges}

    def _place(self, read: int) -> int:
        self._words.append({})
        self._any.append(None)
        self._empty.append([])
        self._read.append(read)
        return len(self._words) - 1

    def _sequence(self, nodes: Sequence[Node], at: int, mandatory: bool) -> int:
        for node in nodes:
            at = self._node(node, at, mandatory)
        return at

    def _node(self, node: Node, at: int, mandatory: bool) -> int:
        kind = node[0]
        read = self._read[at]
        if kind == "word":
            target = self._place(read + mandatory)
            if node[1] in self._words[at]:  # two edges with one word: leave by an empty step
                at, before = self._place(read), at
                self._empty[before].append(at)
            self._words[at][node[1]] = target
            return target
        if kind == "any":
            places = [at]
            for _ in range(node[2]):
                target = self._place(read)
                before = places[-1]
                self._any[before] = target
                places.append(target)
            end = self._place(read)
            for p in places[node[1]:]:
                self._empty[p].append(end)
            return end
        if kind == "optional":
            inside = self._place(read)
            self._empty[at].append(inside)
            last = self._sequence(node[1], inside, mandatory=False)
            end = self._place(read)
            self._empty[at].append(end)
            self._empty[last].append(end)
            return end
        # a choice counts as one mandatory word, whatever its length
        end = self._place(read + mandatory)
        for wording in node[1]:
            inside = self._place(read)
            self._empty[at].append(inside)
            self._empty[self._sequence(wording, inside, mandatory=False)].append(end)
        return end

    def _closed(self, places: Sequence[int]) -> frozenset[int]:
        seen, todo = set(places), list(places)
        while todo:
            for p in self._empty[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)

    def step(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        if word not in self._known:
            word = b""
        found = self._steps.get((state, word))
        if found is None:
            after = [self._words[p][word] for p in state if word in self._words[p]]
            after += [self._any[p] for p in state if self._any[p] is not None]
            found = self._steps[state, word] = self._closed(after)
        return found

    def progress(self, state: frozenset[int]) -> int:
        found = self._progress.get(state)
        if found is None:
            found = self._progress[state] = max(self._read[p] for p in state)
        return found

    def anchors(self) -> set[tuple[bytes, ...]]:
        """The first words, up to ``ANCHOR`` of them, of everything that the automaton accepts."""
        out, todo = set(), [((), self.start)]
        while todo:
            words, state = todo.pop()
            free = any(self._any[p] is not None for p in state)
            if len(words) == ANCHOR or self._end in state or free:
                out.add(words)
                continue
            todo += [((*words, w), self.step(state, w)) for w in {w for p in state for w in self._words[p]}]
        return out

    def run(self, words: Sequence[bytes], at: int) -> tuple[int, int]:
        """(words read up to the first acceptance or 0, most mandatory words got through) from a place on."""
        state, best = self.start, 0
        for n, k in enumerate(range(at, len(words)), 1):
            state = self.step(state, words[k])
            if not state:
                break
            best = max(best, self.progress(state))
            if self._end in state:
                return n, self.mandatory
        return 0, best


class Scanner:
    """All templates and phrases, with the wordings to look for first."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]) -> None:
        self.automata = [(label, Automaton(markup)) for label, markup in templates]
        starts: dict[bytes, list[int]] = {}
        for k, (_, automaton) in enumerate(self.automata):
            for words in automaton.anchors():
                if not words:
                    raise TemplateError("a template that may begin with any word")
                starts.setdefault(b" %s " % b" ".join(words), []).append(k)
        self.starts = sorted(starts.items())
        self.phrases = [(b" %s " % b" ".join(words_of(p)), label) for p, label in phrases]

    @staticmethod
    def places(joined: bytes, wanted: bytes) -> Iterator[int]:
        """Word numbers at which a wording with blanks around it stands."""
        at, counted, number = joined.find(wanted), 0, 0
        while at >= 0:
            number += joined.count(b" ", counted, at)
            counted = at
            yield number
            at = joined.find(wanted, at + 1)

    def scan(self, raw: bytes) -> dict:
        words = words_of(raw)
        joined = b" %s " % b" ".join(words)
        mentions = sorted((n, label) for wanted, label in self.phrases for n in self.places(joined, wanted))
        score = MENTIONED if mentions else 0.0
        matches = set()
        for wanted, owners in self.starts:
            for n in self.places(joined, wanted):
                for k in owners:
                    label, automaton = self.automata[k]
                    length, read = automaton.run(words, n)
                    score = max(score, read / automaton.mandatory)
                    if length:
                        matches.add((n, length, label))
        return {
            "n_words": len(words), "mentions": [{"label": x, "start": n} for n, x in mentions],
            "matches": [{"label": x, "start": n, "length": m} for n, m, x in sorted(matches)], "score": score}


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, phrases)


_ARROW = pa.struct([
    ("n_words", pa.int64()), ("mentions", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))), ("score", pa.float64())])


def scanned(text: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """Number of words, phrases, accepted templates and score of a text."""
    templates, phrases = tuple(templates), tuple(phrases)
    scanner(templates, phrases)  # markup that cannot be read fails here

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = scanner(templates, phrases)
        for batch in batches:
            yield pa.array([one.scan(raw or b"") for raw in batch.cast(pa.binary()).to_pylist()], _ARROW)

    return scan(text)


def found(df: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
          phrases: Sequence[tuple[str, str]] = PHRASES) -> tuple[DataFrame, str]:
    """The table with one more struct column (its name is the second result): n_words, mentions, matches, score."""
    out = free_name(df, "licenses")
    return df.withColumn(out, scanned(F.col(f"`{text}`"), templates, phrases)), out
