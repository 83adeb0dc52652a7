"""A small register language for searches, compiled to DataFrames.

One instruction a line: an opcode, then operands split like shell words, where commas count as blanks and `;` starts a
comment. Registers hold numbers, query vectors, cluster lists or lazy DataFrames; only COARSE looks at data on the driver (the
centroids), and RET returns a register as it is.

    MOV dst, value          QLOAD q, $query        QNORM q             COARSE dst, q, probes
    SCAN dst, clusters, q   TOPK dst, scores, k    FILTER dst, src, ==, key:value     RET register
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ravelin.operators import search


@dataclass(frozen=True)
class Instruction:
    op: str
    args: tuple[str, ...]
    line: int


@dataclass(frozen=True)
class Program:
    instructions: tuple[Instruction, ...]


#: What runs when no program is given.
DEFAULT = """
MOV k, $k
MOV probes, $nprobe
QLOAD q, $query
QNORM q
COARSE near, q, probes
SCAN found, near, q
TOPK best, found, k
RET best
"""


@dataclass
class _Scored:
    """What SCAN leaves: a lazy table and the clusters it reads."""

    frame: Any
    cids: list[int]


class Machine:
    """Registers of one run over one index."""

    def __init__(self, index, bound: dict[str, Any]):
        self.index, self.bound, self.registers = index, bound, {}

    def value(self, token: str) -> Any:
        """A binding for $name; else a register, a whole number, a number or the word itself, whichever fits first."""
        if token[:1] == "$":
            name = token[1:]
            if name in self.bound:
                return self.bound[name]
            raise KeyError(f"nothing is bound to {token}")
        if token in self.registers:
            return self.registers[token]
        for kind in (int, float):
            try:
                return kind(token)
            except ValueError:
                pass
        return token

    def mov(self, dst: str, token: str) -> None:
        self.registers[dst] = self.value(token)

    def qload(self, dst: str, token: str) -> None:
        self.registers[dst] = search.prepare_query(self.value(token), self.index.dim)

    def qnorm(self, name: str) -> None:
        self.registers[name] = search.normalize_query(self.registers[name])

    def coarse(self, dst: str, query: str, probes: str) -> None:
        self.registers[dst] = search.coarse(self.index.centroids, self.registers[query], int(self.value(probes)))

    def scan(self, dst: str, clusters: str, query: str) -> None:
        cids = [int(c) for c in self.registers[clusters]]
        self.registers[dst] = _Scored(search.scan(self.index.postings, cids, self.registers[query]), cids)

    def topk(self, dst: str, scores: str, k: str) -> None:
        found: _Scored = self.registers[scores]
        winners = search.top_k(found.frame, min(int(self.value(k)), int(self.index.sizes[found.cids].sum())))
        self.registers[dst] = search.with_metadata(winners, self.index.postings, found.cids) if self.index.has_metadata else winners

    def filter(self, dst: str, source: str, relation: str, expression: str) -> None:
        if relation != "==":
            raise SyntaxError(f"FILTER knows only ==, not {relation}")
        self.registers[dst] = search.filter_results(self.registers[source], expression)


#: Number of operands and what they do.
_OPS: dict[str, tuple[int, Callable | None]] = {
    "MOV": (2, Machine.mov),
    "QLOAD": (2, Machine.qload),
    "QNORM": (1, Machine.qnorm),
    "COARSE": (3, Machine.coarse),
    "SCAN": (3, Machine.scan),
    "TOPK": (3, Machine.topk),
    "FILTER": (4, Machine.filter),
    "RET": (1, None),
}


def parse_line(text: str, number: int) -> Instruction | None:
    words = shlex.split(text.partition(";")[0].replace(",", " "))
    if not words:
        return None
    op, args = words[0].upper(), tuple(words[1:])
    if op not in _OPS:
        raise SyntaxError(f"line {number}: there is no instruction {op}")
    if len(args) != _OPS[op][0]:
        raise SyntaxError(f"line {number}: {op} takes {_OPS[op][0]} operands, not {len(args)}")
    return Instruction(op, args, number)


def assemble(source: str) -> Program:
    """SyntaxError for unknown instructions, wrong numbers of operands, or a program that doesn't end with RET."""
    parsed = (parse_line(text, i) for i, text in enumerate(re.split(r"\r\n|\r|\n", source), start=1))  # other separators may stand in values
    instructions = tuple(x for x in parsed if x is not None)
    if not instructions or instructions[-1].op != "RET":
        raise SyntaxError("the last instruction must be RET")
    return Program(instructions)


def run(program: Program, index, **bound: Any) -> Any:
    """The returned register: a DataFrame, a vector, a cluster list or a number."""
    machine = Machine(index, bound)
    for step in program.instructions:
        if step.op == "RET":
            result = machine.registers[step.args[0]]
            return result.frame if isinstance(result, _Scored) else result
        _OPS[step.op][1](machine, *step.args)
    raise AssertionError("an assembled program ends with RET")
