"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern and a validator: ranges of an address's parts, Luhn's sum for cards, a
number's digits, mod 97 for bank accounts, the issuing rules of social security numbers.  A
confirmed span starts from its kind's score, which words around it raise or lower; spans of the
kinds in ``BASE`` always stay, others from ``LEAST`` on.  Texts are worked on where they lie, in
one pass without a shuffle.  Patterns are scanned so that a text costs time in proportion to its
length, whatever it holds: runs are taken whole, never again from each of their places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit

BASE = ("email", "ip", "card", "phone")
#: Scores that spans of kinds beyond ``BASE`` need, and what a word nearby adds or takes.
LEAST, WORD_NEARBY = 0.6, 0.3
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# the letter or digit before a span is looked for behind its first character, so that the scan still jumps to such
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9_][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])")
_SSN = re.compile(r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])")


def luhn(digits: str) -> bool:
    """Whether the digits' sum, every second one from the right doubled, ends in 0."""
    twice = "0246813579"
    return (sum(map(int, digits[::-2])) + sum(int(twice[int(d)]) for d in digits[-2::-2])) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number's check digits are right; letters count 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the next match may begin
    for m in _DOMAIN.finditer(text):
        at = m.start()
        local = at - free - len(text[free:at].rstrip(_LOCAL))
        if local:
            yield at - local, m.end()
        free = m.end() if local else at + 1


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _GROUPED.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod_97(m.group().replace(" ", "")):
            yield m.span()


def _social(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


@dataclass(frozen=True)
class Kind:
    """What finds a kind's confirmed spans, the score they start from, and words that raise or lower it."""

    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    raised_by: str
    lowered_by: str = ""

    def scored(self, text: str) -> list[tuple[str, int, int, float]]:
        out = []
        up, down = (re.compile(rf"(?<![a-z0-9])(?:{w})(?![a-z0-9])") if w else None for w in (self.raised_by, self.lowered_by))
        for start, end in self.find(text):
            around = f"{text[max(0, start - BEFORE) : start]}\n{text[end : end + AFTER]}".lower()
            score = self.score + WORD_NEARBY * (up is not None and bool(up.search(around))) - WORD_NEARBY * (down is not None and bool(down.search(around)))
            if self.name in BASE or score >= LEAST - 1e-9:
                out.append((self.name, start, end, round(min(1.0, max(0.0, score)), 2)))
        return out


#: In the order in which kinds are listed.
KINDS = (
    Kind("email", _emails, 0.9, "e-?mail|contact|write to", "example"),
    Kind("ip", _addresses, 0.6, "ip|server|host|address", "version|release|section"),
    Kind("card", _cards, 0.7, "card|visa|mastercard|credit|karte", "order|serial|isbn"),
    Kind("phone", _phones, 0.6, "phone|tel|call|fax|mobile", "score"),
    Kind("iban", _accounts, 0.7, "iban|account|konto|bank"),
    Kind("ssn", _social, 0.3, "ssn|social security", "part|item|serial"),
)

SPAN = "struct<kind: string, start: bigint, `end`: bigint, score: double>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """One row per input row: id_col, found (spans of kind, start, end in code points, score), and, if asked for, masked.

    Spans are ordered by kind as in ``KINDS``, then by start; spans of one kind never overlap,
    those of different kinds may.  In ``masked`` each run of overlapping spans is the first's
    kind in brackets.  A null text is an empty one and has no spans; so has a text without
    matches.  Rows that repeat an id, or have none, are each looked at alone.  Texts may be of
    any length; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))

    def find(batches):
        for batch in batches:
            for row, end, _, _ in _kit.slices(batch["text"]):
                texts = batch["text"].slice(row, end - row).to_pylist()
                each = [[s for kind in KINDS for s in kind.scored(t)] for t in texts]
                flat = [s for spans in each for s in spans]
                columns = [pa.array([s[i] for s in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
                spans = pa.StructArray.from_arrays(columns, ["kind", "start", "end", "score"])
                at = pa.array(np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, end - row), pa.ListArray.from_arrays(at, spans), *([pa.array([hidden(t, x) for t, x in zip(texts, each, strict=True)], pa.string())] if masked else [])],
                    ["id", "found", *(["masked"] if masked else [])],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(find, f"id {kind}, found array<{SPAN}>" + ", masked string" * masked).withColumnRenamed("id", id_col)


def hidden(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each run of overlapping spans replaced by the first's kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def counted(kind: str) -> Column:
    """The number of spans of a kind in found."""
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def listed(kinds: tuple[str, ...] | None = None) -> Column:
    """The spans in found, of some kinds or of all, as kind:start:end, comma-joined."""
    of = F.col("found") if kinds is None else F.filter("found", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
