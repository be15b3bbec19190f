"""Calculator functions (a small typed stack language) as columns and as values.

``compile_columns`` runs a program on symbolic values, so a program whose stack
shape is known beforehand becomes one Catalyst expression; ``evaluate`` runs
any program on numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STACK = 100
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


class CalculatorError(ValueError):
    """A program that cannot be parsed or run."""


def parse(text: str) -> list:
    """Nested lists of operators, numbers and blocks of the program between its braces."""
    tokens = re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", " ", text))
    if not tokens or tokens[0] != "{":
        raise CalculatorError("a program starts with a brace")
    stack: list[list] = [[]]
    for token in tokens:
        if token == "{":
            stack.append([])
        elif token == "}":
            if len(stack) < 2:
                raise CalculatorError("unbalanced braces")
            block = stack.pop()
            stack[-1].append(block)
        elif re.fullmatch(r"[+-]?\d+", token) and INT_MIN <= int(token) <= INT_MAX:
            stack[-1].append(int(token))
        elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", token):
            stack[-1].append(float(token))
        elif token in ("true", "false"):
            stack[-1].append(token == "true")
        else:
            stack[-1].append(token)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise CalculatorError("unbalanced braces")
    return stack[0][0]


def _is_int(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _number(v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise CalculatorError("a number is needed")
    return v


def _fitted(v: float, whole: bool) -> float | int:
    """An integer when all operands were and the value fits 32 bits; finite always."""
    if isinstance(v, float) and not math.isfinite(v):
        raise CalculatorError("result out of range")
    return int(v) if whole and INT_MIN <= v <= INT_MAX else float(v)


def _shift(a: int, by: int) -> int:
    bits = a & 0xFFFFFFFF
    if abs(by) >= 32:
        return 0
    bits = bits << by & 0xFFFFFFFF if by >= 0 else bits >> -by
    return bits - 2**32 if bits > INT_MAX else bits


def _trig(f, degrees: float) -> float:
    return f(math.radians(math.fmod(degrees, 360)))


_UNARY = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc,
}
_REAL = {"sin": lambda a: _trig(math.sin, a), "cos": lambda a: _trig(math.cos, a), "sqrt": math.sqrt, "ln": math.log, "log": math.log10, "cvr": float}
_ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}
_ORDER = {"ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}
_LOGIC = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b}


def _binary(op: str, a: object, b: object) -> object:
    if op in ("eq", "ne"):
        same = isinstance(a, bool) == isinstance(b, bool) and a == b
        return same == (op == "eq")
    if op in _LOGIC:
        if isinstance(a, bool) != isinstance(b, bool) or not (isinstance(a, bool) or _is_int(a) and _is_int(b)):
            raise CalculatorError("mixed logical operands")
        return _LOGIC[op](a, b)
    if op in _ORDER:
        return _ORDER[op](_number(a), _number(b))
    whole = _is_int(a) and _is_int(b)
    _number(a), _number(b)
    if op in _ARITHMETIC:
        return _fitted(_ARITHMETIC[op](a, b), whole)
    if op == "exp":
        return _fitted(math.pow(a, b), False)
    if op == "atan":
        if a == 0 and b == 0:
            raise CalculatorError("undefined angle")
        return math.degrees(math.atan2(a, b)) % 360
    if op == "div":
        if b == 0:
            raise CalculatorError("division by zero")
        return _fitted(a / b, False)
    if not whole:
        raise CalculatorError("integers are needed")
    if op == "bitshift":
        return _shift(a, b)
    if b == 0:
        raise CalculatorError("division by zero")
    quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    return _fitted(quotient, True) if op == "idiv" else a - quotient * b


def evaluate(program: list, inputs: list[float]) -> list[float]:
    """The numbers a program leaves on the stack."""
    stack: list = [float(v) for v in inputs]

    def pop() -> object:
        if not stack:
            raise CalculatorError("empty stack")
        return stack.pop()

    def whole() -> int:
        v = pop()
        if not _is_int(v):
            raise CalculatorError("an integer is needed")
        return v

    def run(block: list) -> None:
        for at, op in enumerate(block):
            if not isinstance(op, (str, list)):
                stack.append(op)
            elif isinstance(op, list):
                if at + 1 >= len(block) or not (block[at + 1] in ("if", "ifelse") or isinstance(block[at + 1], list)):
                    raise CalculatorError("a block without a condition")
            elif op in ("if", "ifelse"):
                test = pop()
                if not isinstance(test, bool):
                    raise CalculatorError("a condition is needed")
                if test:
                    run(block[at - (2 if op == "ifelse" else 1)])
                elif op == "ifelse":
                    run(block[at - 1])
            elif op == "pop":
                pop()
            elif op == "dup":
                v = pop()
                stack.extend((v, v))
            elif op == "exch":
                b, a = pop(), pop()
                stack.extend((b, a))
            elif op in ("copy", "index"):
                n = whole()
                if n < 0 or n > len(stack) - (op == "index"):
                    raise CalculatorError("stack too short")
                if n or op == "index":
                    stack.extend(stack[-n:] if op == "copy" else [stack[-1 - n]])
            elif op == "roll":
                by, n = whole(), whole()
                if n < 0 or n > len(stack):
                    raise CalculatorError("stack too short")
                if n:
                    top = stack[-n:]
                    stack[-n:] = top[-(by % n) :] + top[: -(by % n)] if by % n else top
            elif op == "not":
                v = pop()
                if not (isinstance(v, bool) or _is_int(v)):
                    raise CalculatorError("a logical operand is needed")
                stack.append(not v if isinstance(v, bool) else ~v)
            elif op == "cvi":
                v = math.trunc(_number(pop()))
                if not INT_MIN <= v <= INT_MAX:
                    raise CalculatorError("result out of range")
                stack.append(v)
            elif op in _UNARY:
                v = _number(pop())
                stack.append(_fitted(_UNARY[op](v), _is_int(v)))
            elif op in _REAL:
                v = _number(pop())
                try:
                    stack.append(_fitted(_REAL[op](v), False))
                except ValueError as e:
                    raise CalculatorError(str(e)) from e
            else:
                b, a = pop(), pop()
                try:
                    stack.append(_binary(op, a, b))
                except OverflowError as e:
                    raise CalculatorError(str(e)) from e
            if len(stack) > STACK:
                raise CalculatorError("stack overflow")

    run(program)
    return [float(_number(v)) for v in stack]


@dataclass(frozen=True)
class Symbol:
    """A column with its kind: real, int or bool; ``literal`` if known beforehand.

    ``real`` is a number's value. An int's ``column`` is null in the rows where the
    value has left 32 bits and so become real.
    """

    kind: str
    column: Column
    literal: object = None
    value: Column | None = None
    level: int = 0  # of the projection that holds it

    @property
    def real(self) -> Column:
        return self.column.cast("double") if self.value is None else self.value


def _finite(c: Column) -> Column:
    """Infinities and undefined numbers are errors, here null."""
    return F.when(F.abs(c) <= 1.7976931348623157e308, c)


def _real(c: Column) -> Symbol:
    return Symbol("real", _finite(c.cast("double")))


def _int(c: Column, value: Column) -> Symbol:
    return Symbol("int", F.when(c.between(INT_MIN, INT_MAX), c), None, F.coalesce(c.cast("double"), value))


def _known(v: object) -> Symbol:
    kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "real"
    return Symbol(kind, F.lit(v).cast({"bool": "boolean", "int": "long", "real": "double"}[kind]), v)


_COLUMN_UNARY = {
    "abs": F.abs, "neg": lambda a: -a, "ceiling": F.ceil, "floor": F.floor, "round": lambda a: F.floor(a + 0.5),
    "truncate": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)),
}
_COLUMN_REAL = {
    "sin": lambda a: F.sin(F.radians(a % 360)), "cos": lambda a: F.cos(F.radians(a % 360)), "sqrt": F.sqrt, "ln": F.ln, "log": F.log10, "cvr": lambda a: a,
}


def operation(op: str, *args: Symbol) -> Symbol:
    """One operator on symbolic operands; undefined results are null."""
    a = args[0]
    if op in ("if", "ifelse"):
        raise CalculatorError("branches are compiled with their blocks")
    if len(args) == 1:
        if op == "not":
            return Symbol("bool", ~a.column) if a.kind == "bool" else _int(F.bitwise_not(a.column), F.lit(None).cast("double"))
        if op == "cvi":
            whole = _COLUMN_UNARY["truncate"](F.when(F.abs(a.real) <= 2.0**62, a.real)).cast("long")
            return Symbol("int", F.when(whole.between(INT_MIN, INT_MAX), whole))
        if op in _COLUMN_UNARY:
            if a.kind == "int":
                return _int(_COLUMN_UNARY[op](a.column), _COLUMN_UNARY[op](a.real).cast("double")) if op in ("abs", "neg") else a
            # large reals have no fraction, and no place in a long
            return _real(F.when(F.abs(a.real) < 2.0**52, _COLUMN_UNARY[op](F.when(F.abs(a.real) < 2.0**52, a.real)).cast("double")).otherwise(_COLUMN_UNARY[op](a.real) if op in ("abs", "neg") else a.real))
        return _real(_COLUMN_REAL[op](a.real))
    b = args[1]
    whole = a.kind == b.kind == "int"
    if op in ("eq", "ne"):
        same = F.lit(False) if (a.kind == "bool") != (b.kind == "bool") else a.column == b.column if a.kind == "bool" else a.real == b.real
        return Symbol("bool", same if op == "eq" else ~same)
    if op in _ORDER:
        return Symbol("bool", _ORDER[op](a.real, b.real))
    if op in _LOGIC:
        if a.kind == "bool" and b.kind == "bool":
            return Symbol("bool", {"and": a.column & b.column, "or": a.column | b.column, "xor": a.column != b.column}[op])
        return Symbol("int", {"and": a.column.bitwiseAND, "or": a.column.bitwiseOR, "xor": a.column.bitwiseXOR}[op](b.column))
    if op in _ARITHMETIC:
        value = _finite(_ARITHMETIC[op](a.real, b.real))
        return _int(_ARITHMETIC[op](a.column, b.column), value) if whole else Symbol("real", value)
    if op == "div":
        return _real(F.try_divide(a.real, b.real))
    if op == "exp":
        return _real(F.pow(a.real, b.real))
    if op == "atan":
        angle = F.degrees(F.atan2(a.real, b.real))
        return Symbol("real", F.when((a.real == 0) & (b.real == 0), None).when(angle < 0, angle + 360).otherwise(angle))
    if op == "idiv":
        quotient = F.try_divide(a.column - F.try_mod(a.column, b.column), b.column).cast("long")
        return _int(quotient, F.lit(None).cast("double"))
    if op == "mod":
        return Symbol("int", F.try_mod(a.column, b.column))
    if op == "bitshift" and _is_int(b.literal):
        low = a.column.bitwiseAND(F.lit(0xFFFFFFFF))
        bits = F.lit(0).cast("long") if abs(b.literal) >= 32 else F.shiftleft(low, b.literal).bitwiseAND(F.lit(0xFFFFFFFF)) if b.literal >= 0 else F.shiftright(low, -b.literal)
        return Symbol("int", F.when(a.column.isNotNull(), F.when(bits > INT_MAX, bits - 2**32).otherwise(bits)))
    raise CalculatorError(f"no column form of {op}")


_ONE_OPERAND = {*_UNARY, *_REAL, "not", "cvi"}


def _either(test: Column, a: Symbol, b: Symbol) -> Symbol:
    """What a branch leaves; ``test`` null (an error) leaves nothing."""
    pick = lambda x, y: F.when(test, x).when(~test, y)
    if a.kind == b.kind != "int":
        return Symbol(a.kind, pick(a.column, b.column))
    if a.kind == b.kind:
        return Symbol("int", pick(a.column, b.column), None, pick(a.real, b.real))
    return Symbol("real", pick(a.real, b.real))


def with_programs(df: DataFrame, programs: dict[str, tuple[list, list[Column]]]) -> DataFrame:
    """``df`` with a column for each program (its topmost result, over the given inputs).

    Every intermediate value is a column of a projection of its own level, so an
    operand is computed once however many operators, branches and forms (whole or
    real) use it, and the plan grows with the program, not with its paths.
    """
    levels: list[dict[str, Column]] = []

    def bind(s: Symbol, level: int) -> Symbol:
        while len(levels) <= level:
            levels.append({})

        def put(c: Column) -> Column:
            name = f"_v{level}_{len(levels[level])}"
            levels[level][name] = c
            return F.col(name)

        return Symbol(s.kind, put(s.column), s.literal, None if s.value is None else put(s.value), level + 1)

    last = {name: compile_columns(program, inputs, bind)[-1] for name, (program, inputs) in programs.items()}
    out = df
    for level in levels:
        out = out.withColumns(level)
    return out.select(*df.columns, *[c.alias(name) for name, c in last.items()])


def compile_columns(program: list, inputs: list[Column], bind: Callable[[Symbol, int], Symbol] | None = None) -> list[Column]:
    """Columns of the program's results; stack operators need literal counts.

    ``bind`` may give each new value a name, at the level after its operands'.
    """

    def held(s: Symbol, *operands: Symbol) -> Symbol:
        return s if bind is None or s.literal is not None else bind(s, max((o.level for o in operands), default=0))

    def literal(stack: list[Symbol]) -> int:
        v = stack.pop().literal
        if not _is_int(v):
            raise CalculatorError("a literal count is needed")
        return v

    def run(block: list, stack: list[Symbol]) -> list[Symbol]:
        for at, op in enumerate(block):
            if isinstance(op, list):
                continue
            if not isinstance(op, str):
                stack.append(_known(op))
            elif op in ("if", "ifelse"):
                asked = stack.pop()
                test = asked.column
                yes = run(block[at - (2 if op == "ifelse" else 1)], list(stack))
                no = run(block[at - 1], list(stack)) if op == "ifelse" else stack
                if len(yes) != len(no):
                    raise CalculatorError("branches leave different stacks")
                stack = [a if a is b else held(_either(test, a, b), asked, a, b) for a, b in zip(yes, no, strict=True)]
            elif op == "pop":
                stack.pop()
            elif op == "dup":
                stack.append(stack[-1])
            elif op == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif op == "copy":
                n = literal(stack)
                stack.extend(stack[len(stack) - n :])
            elif op == "index":
                n = literal(stack)
                stack.append(stack[-1 - n])
            elif op == "roll":
                by, n = literal(stack), literal(stack)
                top = stack[len(stack) - n :]
                by %= n or 1
                stack[len(stack) - n :] = top[n - by :] + top[: n - by]
            elif op in _ONE_OPERAND:
                a = stack.pop()
                stack.append(held(operation(op, a), a))
            else:
                b, a = stack.pop(), stack.pop()
                stack.append(held(operation(op, a, b), a, b))
        return stack

    return [s.real for s in run(program, [held(Symbol("real", c.cast("double"))) for c in inputs])]
