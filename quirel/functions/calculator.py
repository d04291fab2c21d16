"""Calculator functions (type 4) compiled to column expressions: the stack holds columns, so evaluation stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: columns on the stack at most.
STACK = 100


class CalculatorError(ValueError):
    """A program that can't be compiled."""


def _tree(source: str) -> list:
    tokens = re.findall(r"[{}]|[^\s{}]+", source)
    stack: list[list] = [[]]
    for t in tokens:
        if t == "{":
            stack.append([])
        elif t == "}":
            if len(stack) < 2:
                raise CalculatorError("closed without being open")
            stack[-2].append(stack.pop())
        else:
            stack[-1].append(t)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise CalculatorError("not one procedure")
    return stack[0][0]


def _truth(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / F.when(b != 0, b), "exp": lambda a, b: F.pow(a, b),
    "idiv": lambda a, b: _trunc(_trunc(a) / F.when(_trunc(b) != 0, _trunc(b))), "mod": lambda a, b: _trunc(a) % F.when(_trunc(b) != 0, _trunc(b)),
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
    "eq": lambda a, b: _truth(a == b), "ne": lambda a, b: _truth(a != b), "gt": lambda a, b: _truth(a > b), "ge": lambda a, b: _truth(a >= b), "lt": lambda a, b: _truth(a < b), "le": lambda a, b: _truth(a <= b),
    "and": lambda a, b: a.cast("long").bitwiseAND(b.cast("long")).cast("double"), "or": lambda a, b: a.cast("long").bitwiseOR(b.cast("long")).cast("double"), "xor": lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")).cast("double"),
}
_ONE = {
    "neg": lambda a: -a, "abs": lambda a: F.abs(a), "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": lambda a: F.floor(a + 0.5).cast("double"), "truncate": lambda a: _trunc(a), "sqrt": lambda a: F.sqrt(a),
    "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "ln": lambda a: F.log(a), "log": lambda a: F.log10(a), "cvi": lambda a: _trunc(a), "cvr": lambda a: a, "not": lambda a: _truth(a == 0),
}


def _trunc(a: Column) -> Column:
    return F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double")


def _run(program: list, stack: list[Column]) -> list[Column]:
    pending: list[list] = []
    constant: list[float | None] = [None] * len(stack)
    for t in program:
        if isinstance(t, list):
            pending.append(t)
            continue
        if t in ("if", "ifelse"):
            other = pending.pop() if t == "ifelse" else []
            then, test = pending.pop(), stack.pop()
            yes, no = _run(then, list(stack)), _run(other, list(stack))
            if len(yes) != len(no):
                raise CalculatorError("branches of unlike depth")
            stack = [y if y is n else F.when(test != 0, y).otherwise(n) for y, n in zip(yes, no)]
            constant = [None] * len(stack)
            continue
        try:
            number = float(t)
        except ValueError:
            number = None
        if number is not None or t in ("true", "false"):
            stack.append(F.lit(number if number is not None else float(t == "true")))
            constant = constant[: len(stack) - 1] + [number]
        elif t in _TWO and len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append(_TWO[t](a, b))
        elif t in _ONE and stack:
            stack.append(_ONE[t](stack.pop()))
        elif t == "pop" and stack:
            stack.pop()
        elif t == "exch" and len(stack) > 1:
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif t == "dup" and stack:
            stack.append(stack[-1])
        elif t in ("copy", "index", "roll"):
            args = []
            for _ in range(2 if t == "roll" else 1):
                if not stack or len(constant) < len(stack) or constant[len(stack) - 1] is None:
                    raise CalculatorError(f"{t} needs numbers that stand in the program")
                args.append(int(constant[len(stack) - 1]))
                stack.pop()
            if t == "copy":
                stack += stack[len(stack) - args[0] :] if args[0] else []
            elif t == "index":
                stack.append(stack[-1 - args[0]])
            else:
                by, n = args
                if n:
                    part, k = stack[-n:], by % n
                    stack[-n:] = part[-k:] + part[:-k] if k else part
        else:
            raise CalculatorError(f"no operator, or too little on the stack: {t}")
        constant = (constant + [None] * len(stack))[: len(stack)]
        if t in _TWO or t in _ONE or t in ("copy", "index", "roll", "exch", "dup"):
            constant = [None] * len(stack)
        if len(stack) > STACK:
            raise CalculatorError("stack too deep")
    return stack


def calculator(source: str, inputs: list[Column], domain: list[float], codomain: list[float]) -> Column:
    """Outputs of a program as an array, kept within codomain; a program that fails, or a result that is null, gives zeros."""
    kept = [F.least(F.greatest(x.cast("double"), F.lit(float(domain[2 * i]))), F.lit(float(domain[2 * i + 1]))) for i, x in enumerate(inputs)]
    n = len(codomain) // 2
    try:
        out = _run(_tree(source), kept)[-n:]
        if len(out) < n:
            raise CalculatorError("too few results")
    except (CalculatorError, IndexError):
        out = [F.lit(None).cast("double")] * n
    bad = out[0].isNull()
    for o in out[1:]:
        bad = bad | o.isNull()
    keep = lambda v, i: F.least(F.greatest(v, F.lit(float(codomain[2 * i]))), F.lit(float(codomain[2 * i + 1])))
    return F.array(*[keep(F.when(bad, 0.0).otherwise(o), i) for i, o in enumerate(out)])
