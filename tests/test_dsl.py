from __future__ import annotations

import pytest

from ravelin.plans import dsl


class Index:
    dim = 2


def test_assemble_reads_words_comments_and_case():
    program = dsl.assemble("mov k, 3 ; three\n\n ,\nFilter a b == 'tag:two words'\nret a")
    assert [i.op for i in program.instructions] == ["MOV", "FILTER", "RET"]
    assert program.instructions[1].args == ("a", "b", "==", "tag:two words")
    assert [i.line for i in program.instructions] == [1, 4, 5]


def test_comment_wins_over_quotes():
    with pytest.raises(ValueError, match="quotation"):
        dsl.assemble("MOV a 'x;y'\nRET a")


@pytest.mark.parametrize("source", ["", "NOP\nRET a", "MOV a\nRET a", "MOV a 1", "RET", "QNORM a b\nRET a", "; RET a"])
def test_bad_programs(source):
    with pytest.raises(SyntaxError):
        dsl.assemble(source)


def test_values():
    run = lambda text, **bound: dsl.run(dsl.assemble(text), Index(), **bound)
    assert run("MOV a $k\nRET a", k=7) == 7
    assert run("MOV a 5\nMOV b a\nRET b") == 5
    assert run("MOV a 2.7\nRET a") == 2.7
    assert run("MOV a word\nRET a") == "word"
    assert run("MOV 10 3\nMOV a 10\nRET a") == 3  # a register hides the number
    assert run("MOV a 1\nRET a\nMOV a 2\nRET a") == 1
    with pytest.raises(KeyError):
        run("MOV a $missing\nRET a")
    with pytest.raises(KeyError):
        run("MOV A 1\nRET a")  # registers are case-sensitive


def test_query_registers():
    q = dsl.run(dsl.assemble("QLOAD q $query\nQNORM q\nRET q"), Index(), query=[[3], [4]])
    assert q.tolist() == pytest.approx([0.6, 0.8])
    assert dsl.run(dsl.assemble("QLOAD q $query\nQNORM q\nRET q"), Index(), query=[0, 0]).tolist() == [0, 0]
    for bad in ([1, 2, 3], [float("nan"), 1], [1e39, 0]):
        with pytest.raises(ValueError):
            dsl.run(dsl.assemble("QLOAD q $query\nRET q"), Index(), query=bad)
