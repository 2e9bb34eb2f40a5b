"""Secret scanning with one automaton for all rules.

The rules are joined into one non-deterministic automaton that may start anywhere, made
deterministic by subset construction, minimised, and stored as a transition array over classes of
bytes. Texts are cut where every state falls back to the start (a line break, for instance), so
the parts can be scanned side by side: one step of numpy moves all of them by one byte, and one
pass serves every rule. A part in which an accepting state was reached is then read by the rules
themselves to get exact, leftmost, non-overlapping spans; matches cannot leave their part.

Offsets count code points, ends are exclusive. Null counts as empty: no spans. No rows, no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm.tables import documents
from pulseframe.llm.words import slices, text_buffer


@dataclass(frozen=True)
class Rule:
    """``find`` gives the spans; ``least`` is the least length of group ``group``. ``parts`` are what
    the automaton reads: byte sets, each with the least and greatest (None: any) count. They hold
    the beginning of every match, with shorter runs than ``least``: long counts of many rules
    multiply the states, and a part that is found for nothing only costs an exact look."""

    kind: str
    find: str
    group: int
    least: int
    parts: tuple


def _set(spec: str) -> frozenset[int]:
    """Bytes of a character class such as ``A-Z0-9_``."""
    out, i = set(), 0
    while i < len(spec):
        if spec[i + 1 : i + 2] == "-" and i + 2 < len(spec):
            out |= set(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(spec[i]))
            i += 1
    return frozenset(out)


def _word(text: str, any_case: bool = False) -> tuple:
    return tuple((frozenset({ord(c), ord(c.upper()), ord(c.lower())} if any_case else {ord(c)}), 1, 1) for c in text)


VALUE = _set("A-Za-z0-9+/_.=-")
_ASSIGN_TAIL = ((_set("\"'"), 0, 1), (_set(" "), 0, None), (_set(":="), 1, 1), (_set(" "), 0, None), (_set("\"'"), 0, 1), (VALUE, 2, None))
_ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: the base kinds, in the order in which equal starts are listed, then what the method adds
RULES = (
    *(Rule("assign", _ASSIGN, 2, 6, _word(k, True) + _ASSIGN_TAIL) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, _word("AKIA") + ((_set("A-Z0-9"), 4, None),)),
    Rule("hex", r"[0-9a-f]+", 0, 24, ((_set("0-9a-f"), 16, None),)),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 40, _word("gh") + ((_set("opsu"), 1, 1),) + _word("_") + ((_set("A-Za-z0-9"), 4, None),)),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, _word("xox") + ((_set("abprs"), 1, 1),) + _word("-") + ((_set("A-Za-z0-9-"), 4, None),)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, _word("-----BEGIN ") + ((_set("A-Z "), 0, None),) + _word("PRIVATE KEY-----")),
)
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Automaton:
    """``step[state * width + byte_class[byte]]``; states from ``accepting`` on accept, 0 starts."""

    step: np.ndarray
    byte_class: np.ndarray
    width: int
    accepting: int
    resets: np.ndarray


def compile_rules(rules: Iterable[Rule] = RULES) -> Automaton:
    moves: list[list[tuple[frozenset[int], int]]] = []  # of each state of the joined automaton
    skips: list[list[int]] = []
    final = set()

    def new() -> int:
        moves.append([])
        skips.append([])
        return len(moves) - 1

    start = new()
    for rule in rules:
        at = start
        for chars, least, most in rule.parts:
            for _ in range(least):
                to = new()
                moves[at].append((chars, to))
                at = to
            if most is None:
                to = new()
                skips[at].append(to)
                moves[to].append((chars, to))
                at = to
            else:
                for _ in range(most - least):
                    to = new()
                    moves[at].append((chars, to))
                    skips[at].append(to)
                    at = to
        final.add(at)

    def closed(states: Iterable[int]) -> int:
        """The states and all that follow without a byte, as bits of one number."""
        todo, seen = list(states), 0
        while todo:
            if not seen >> (at := todo.pop()) & 1:
                seen |= 1 << at
                todo += skips[at]
        return seen

    sets = list({chars for m in moves for chars, _ in m})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    classes = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([classes[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in classes]
    goes = [[closed(t for chars, t in m if byte in chars) for byte in sample] for m in moves]
    end = closed(final)

    first = closed([start])
    number, rows, todo = {first: 0}, [], [first]
    for state in todo:  # subset construction; the start is always in, since a match may begin anywhere
        if state & end:  # a part that is found needs no more
            rows.append([number[state]] * len(sample))
            continue
        row = [first] * len(sample)
        for at in range(state.bit_length()):
            if state >> at & 1:
                row = [to | more for to, more in zip(row, goes[at])]
        row = [end if to & end else to for to in row]
        for to in row:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
        rows.append([number[to] for to in row])
    step = np.array(rows)
    accepts = np.array([bool(end & s) for s in number])

    block = accepts.astype(int)  # minimisation: split blocks until equal states go to equal blocks
    while True:
        _, fresh = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        fresh = fresh.ravel()
        if fresh.max() == block.max():
            break
        block = fresh
    blocks = block.max() + 1
    leader = np.array([np.flatnonzero(block == b)[0] for b in range(blocks)])
    order = sorted(range(blocks), key=lambda b: (accepts[leader[b]], b != block[0], b))
    place = np.empty(blocks, int)
    place[order] = np.arange(blocks)
    table = place[block[step[leader[order]]]]
    resets = (table[~accepts[leader[order]]] == 0).all(axis=0)[byte_class]
    resets[128:] = False  # parts hold whole characters
    width = table.shape[1]
    return Automaton((table * width).astype(np.int32).ravel(), byte_class, width, int((~accepts[leader]).sum()), resets)


def parts_of(raw: np.ndarray, offsets: np.ndarray, resets: np.ndarray, size: int = 400) -> np.ndarray:
    """Where the parts begin: at every text, and in it after the first reset at least ``size``
    bytes on. A stretch without any reset stays one part, however long."""
    cuts = np.flatnonzero(resets[raw]) + 1
    # of the resets of one grid cell only the last is taken, which leaves parts of a cell or two
    last = np.append(np.diff(cuts // size) != 0, True) if len(cuts) else np.zeros(0, bool)
    begin = np.unique(np.concatenate([offsets[:-1], cuts[last]]))
    return begin[begin < len(raw)]


def scan(raw: np.ndarray, offsets: np.ndarray, auto: Automaton) -> list[tuple[int, int]]:
    """Parts in which some rule accepts, as byte ranges."""
    begin = parts_of(raw, offsets, auto.resets)
    if not len(begin):
        return []
    end = np.append(begin[1:], len(raw))
    order = np.argsort(begin - end, kind="stable")  # the longest first: the active ones lead
    begin, length = begin[order], (end - begin)[order]
    letters = auto.byte_class[raw]
    state = np.zeros(len(begin), np.int32)
    most = np.zeros(len(begin), np.int32)
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # longer than j
    for j in range(length[0]):
        n = active[j]
        now = auto.step[state[:n] + letters[begin[:n] + j]]
        state[:n] = now
        np.maximum(most[:n], now, out=most[:n])
    hit = np.flatnonzero(most >= auto.accepting * auto.width)
    return sorted((int(begin[i]), int(begin[i] + length[i])) for i in hit)


def spans_in(text: str, rules: Iterable[Rule] = RULES) -> list[tuple[int, int, str]]:
    """Exact spans ``(start, end, kind)`` of one part."""
    out = []
    for kind, find, group, least in dict.fromkeys((r.kind, r.find, r.group, r.least) for r in rules):
        out += [(m.start(), m.end(), kind) for m in re.finditer(find, text) if m.end(group) - m.start(group) >= least]
    return out


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: counts of the base kinds, their digest, and all spans as
    ``kind:start:end`` by start, then kind in the order of the rules, joined by commas."""
    auto = compile_rules(rules)
    rank = {k: i for i, k in enumerate(dict.fromkeys(r.kind for r in rules))}

    def text_of(found: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], rank[x[2]])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for part in slices(batches):
            raw, offsets = text_buffer(part.column("text"))
            found: dict[int, list[tuple[int, int, str]]] = {}
            chars = None
            for a, b in scan(raw, offsets, auto):
                doc = int(np.searchsorted(offsets, a, side="right")) - 1
                if chars is None:
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before
                shift = int(chars[a] - chars[offsets[doc]])
                text = raw[a:b].tobytes().decode()
                found.setdefault(doc, []).extend((s + shift, e + shift, k) for s, e, k in spans_in(text, rules))
            rows = []
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                spans = found.get(i, [])
                base = [x for x in spans if x[2] in BASE]
                kinds = [x[2] for x in base]
                rows.append((
                    doc_id, *(kinds.count(k) for k in BASE),
                    hashlib.sha256(text_of(base).encode()).hexdigest() if base else empty, text_of(spans),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return documents(docs).mapInArrow(run, SPANS)
