"""Model terms as Spark columns: numbers, factors with a reference level, products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators.members import levels_of


@dataclass(frozen=True)
class Factor:
    """A categorical term. Levels default to the sorted values found; the first is the reference."""

    col: str
    levels: tuple = ()


Term = str | Factor | tuple


@dataclass
class Design:
    """Named design columns (without intercept) over raw columns."""

    names: list[str] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    blocks: dict[str, list[str]] = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    discrete: bool = True
    known: dict[str, Column] = field(default_factory=dict)
    reference: dict[str, object] = field(default_factory=dict)

    def select(self, df: DataFrame, *others: Column) -> DataFrame:
        """Design columns x0, x1, ... next to `others`, on the rows where the design is known."""
        names = [f"x{i}" for i in range(self.width)]
        for condition in self.known.values():
            df = df.filter(condition)
        out = df.select(*others, *[c.alias(n) for c, n in zip(self.columns, names)])
        return out.dropna(subset=names) if names else out

    def only(self, kept: Sequence[int]) -> Design:
        """The design with these columns alone, in order."""
        names = [self.names[i] for i in kept]
        blocks = {t: [n for n in members if n in names] for t, members in self.blocks.items()}
        return replace(self, names=names, columns=[self.columns[i] for i in kept], blocks=blocks)

    @property
    def width(self) -> int:
        return len(self.names)


def _parts(df: DataFrame, term: str | Factor) -> tuple[str, str, list[tuple[str, Column]], tuple | bool]:
    """(term name, input column, [(name, column)], levels) of one main effect.

    Numbers have no levels: (), or False if they are continuous.
    """
    col = term.col if isinstance(term, Factor) else term
    kind = df.schema[col].dataType
    textual = isinstance(kind, (T.StringType, T.BooleanType))
    if not isinstance(term, Factor) and not textual:
        whole = isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
        return col, col, [(col, F.col(col).cast("double"))], whole and ()
    levels = (term.levels if isinstance(term, Factor) else ()) or tuple(levels_of(df, col))
    if len(levels) < 2:
        raise ValueError(f"factor {col} has fewer than two levels")
    dummies = [
        (f"{col}[{v}]", F.when(F.col(col).isNotNull(), (F.col(col) == F.lit(v)).cast("double")))
        for v in levels[1:]
    ]
    return col, col, dummies, levels


def design(df: DataFrame, terms: Sequence[Term]) -> Design:
    """Columns for a list of terms.

    A text column or `Factor` becomes one 0/1 column per level after the first. A tuple
    of two terms stands for both main effects and their products.
    """
    out = Design()

    def add(name: str, parts: list[tuple[str, Column]]) -> None:
        if name in out.blocks:
            return
        out.blocks[name] = [n for n, _ in parts]
        out.names += [n for n, _ in parts]
        out.columns += [c for _, c in parts]

    products = []
    for term in terms:
        members = [_parts(df, t) for t in (term if isinstance(term, tuple) else (term,))]
        for name, col, parts, levels in members:
            add(name, parts)
            out.discrete = out.discrete and levels is not False
            if levels:
                # a value that is no level is missing, not the reference
                out.known[col] = F.col(col).isin(*levels)
                out.reference[col] = levels[0]
            if col not in out.inputs:
                out.inputs.append(col)
        if len(members) == 2:
            products.append(members)
    for (na, _, pa, _), (nb, _, pb, _) in products:
        add(f"{na}:{nb}", [(f"{i}:{j}", x * y) for j, y in pb for i, x in pa])
    return out
