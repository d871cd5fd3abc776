"""License scans: Aho-Corasick over words for notice phrases and tags, shunting-yard for expressions.

Each whole text is brought to lower-case words (runs of a-z, 0-9 and everything from U+0080 on) with
one space between them; one Aho-Corasick automaton over that string finds every place of every
phrase, overlapping ones too. From each place where it finds an identifier tag
(`SPDX-License-Identifier:`), the rest of the line in the original text goes to a tokenizer and a
shunting-yard parser for and/or/with expressions. The parsed expression is brought to a normal form,
which the results carry, and evaluated: whether permissive licenses alone can meet it.

Scale: one pass over the texts, no shuffle; memory is one Arrow batch and one text's words.

Edge cases: null text counts as empty: 0 words, no places, null first and last word, empty labels,
score 0, no expressions, null permissive. A broken expression (missing operand, open bracket) gives no
expression labels, but its tag still counts as evidence. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Phrase (its words, one space between) to label. Fixed by contract.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Further notice phrases: label and how sure the phrase alone makes us of a license statement.
NOTICES = {
    "affero general public license": ("agpl", 0.9),
    "apache license": ("apache", 0.8),
    "bsd license": ("bsd", 0.8),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc0": ("cc0", 0.7),
    "creative commons": ("creative-commons", 0.7),
    "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "licensed under the": ("notice", 0.5),
    "mit license": ("mit", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "proprietary and confidential": ("proprietary", 0.7),
    "public domain": ("public-domain", 0.5),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
}

BASE_CONFIDENCE = 0.8
TAG = "spdx license identifier"
TAG_CONFIDENCE = 0.95
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AFTER_TAG = re.compile(rb"\s*:[^\S\n]*([^\n]*)")

#: Identifiers that ask for no more than notices to be kept.
PERMISSIVE = {"0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "isc", "mit", "unlicense", "zlib"}

#: Bytes of words stay (A-Z lowered), all other ASCII becomes a space; UTF-8 bytes from 0x80 on stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: with binds closer than and, and closer than or.
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")


def expression_tokens(text: str) -> list[str]:
    """Brackets, operators (lower case) and identifiers from the start of `text`, up to anything else.

    Identifiers must alternate with operators, so prose after an expression ends it.
    """
    out: list[str] = []
    at, operand_next = 0, True
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            break
        token = m[0]
        low = token.lower()
        if token == "(":
            if not operand_next:
                break
        elif token == ")":
            if operand_next:
                break
        elif low in PRECEDENCE:
            if operand_next:
                break
            token, operand_next = low, True
        else:
            if not operand_next:
                break
            operand_next = False
        out.append(token)
        at = m.end()
    return out


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the tokens in postfix order, or None if they are no expression."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out


class Tree(NamedTuple):
    """An expression: a license (no parts), or `and` / `or` over parts, of which none has the same operator.

    form: how it is written; equal expressions have equal forms. Deep ones are walked without recursion.
    """

    name: str
    parts: tuple["Tree", ...]
    form: str

    def folded(self, of_license, of_all, of_any):
        """The value of the expression from those of its parts."""
        done: dict[int, object] = {}
        todo = [(self, False)]
        while todo:
            tree, ready = todo.pop()
            if not tree.parts:
                done[id(tree)] = of_license(tree.name)
            elif ready:
                done[id(tree)] = (of_all if tree.name == "and" else of_any)([done[id(p)] for p in tree.parts])
            else:
                todo.append((tree, True))
                todo += [(p, False) for p in tree.parts]
        return done[id(self)]

    def met(self, allowed) -> bool:
        """Whether licenses for which allowed(license) holds are enough."""
        return self.folded(allowed, all, any)

    def choices(self) -> set[frozenset[str]]:
        """The sets of licenses that hold together, one for each way to choose at every `or`."""
        return self.folded(lambda name: {frozenset([name])}, lambda parts: {frozenset().union(*c) for c in product(*parts)}, lambda parts: set().union(*parts))


def license_of(name: str) -> Tree:
    return Tree(name, (), name)


def joined(operator: str, left: Tree, right: Tree) -> Tree:
    """Normal form: parts of the same operator are taken up, repeated ones once, in order."""
    parts = {q.form: q for p in (left, right) for q in (p.parts if p.name == operator and p.parts else (p,))}
    own = tuple(parts[form] for form in sorted(parts))
    if len(own) == 1:
        return own[0]
    return Tree(operator, own, f" {operator} ".join(f"({p.form})" if operator == "and" and p.parts else p.form for p in own))


def evaluated(text: str) -> tuple[list[str], Tree] | None:
    """Licenses named in an expression, in order, and the expression; None for a broken one.

    `with` ties an exception to the license before it.
    """
    postfix = to_postfix(expression_tokens(text))
    if not postfix:
        return None
    names: list[str] = []
    stack: list[Tree] = []
    for token in postfix:
        if token not in PRECEDENCE:
            names.append(token.lower())
            stack.append(license_of(token.lower()))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if left.parts or right.parts or " " in right.name:
                return None
            names[-2:] = [f"{left.name} with {right.name}"]
            stack.append(license_of(names[-1]))
        else:
            stack.append(joined(token, left, right))
    return (names, stack[0]) if len(stack) == 1 else None


def permissive(name: str) -> bool:
    """An exception only adds permissions, so it leaves a permissive license one."""
    return name.split(" with ")[0] in PERMISSIVE


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and the tag, each between spaces, so that only whole words match."""
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one text."""
    text = text or ""
    words = words_of(text)
    folded = b" ".join([b"", *words, b""]).decode("latin-1")
    places = [(end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(folded)]
    base = sorted(start for start, phrase in places if phrase in BASE)
    base_labels = {BASE[phrase] for _, phrase in places if phrase in BASE}
    labels, doubt, trees = set(base_labels), 1.0, []
    for phrase in sorted({phrase for _, phrase in places}):
        if phrase in BASE:
            doubt *= 1 - BASE_CONFIDENCE
        elif phrase in NOTICES:
            label, sure = NOTICES[phrase]
            labels.add(label)
            doubt *= 1 - sure
    tags = [folded.count(" ", 0, start) for start, phrase in places if phrase == TAG]
    if tags:
        doubt *= 1 - TAG_CONFIDENCE
        for rest in after_tags(text, tags):
            found = evaluated(rest)
            if found:
                labels.update(found[0])
                trees.append(found[1])
    # The string starts with a space before word 0, so word k is the one after k + 1 spaces.
    first = folded.count(" ", 0, base[0]) if base else None
    last = folded.count(" ", 0, base[-1]) if base else None
    return (len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - doubt, [t.form for t in trees], all(t.met(permissive) for t in trees) if trees else None)


def after_tags(text: str, tags: list[int]) -> Iterator[str]:
    """What follows the tags that begin at these words (counted as the automaton does) up to the line's end."""
    raw = text.encode("utf-8", "surrogatepass")
    last = {k + len(TAG.split()) - 1 for k in tags}
    for k, m in enumerate(_WORD.finditer(raw)):
        if k in last:
            rest = _AFTER_TAG.match(raw, m.end())
            if rest:
                yield rest[1].decode("utf-8", "surrogatepass")


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in slices(batches):
        found = zip(*(scan(t.as_py()) for t in batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kind) for v, kind in zip(map(list, found), _ARROW))], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, text), see SCHEMA."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan_batches, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("expressions", F.concat_ws("; ", "expressions"))
