"""The graphics state along content streams, as joins and windows over ``content_ops``.

``q`` and ``Q`` are brackets: running sums give the depth, and an operation is of the scope that the last ``q`` of its depth opened (a ``Q`` without one does
nothing). What an operation sets holds in its scope from there on, so within a scope the state is a running last value, and the matrix is
a running product, made in logarithmic rounds of ``lag`` because products of affine matrices are associative. What a scope begins with is what
its parent had at the ``q``; the ways up through parents are put together in rounds that look twice as far each time.

Text lines are scans too: ``BT`` and ``Tm`` start anew, and all moves after them are translations, which add up.

Cases: operations whose operands are too few or no numbers set nothing; a ``Q`` without ``q`` and a ``q`` without ``Q`` are allowed; pages without operations give no
rows; other columns are not returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graph

KEY = ["file_id", "page_index"]
#: What each variable is before anything sets it, and the operator that sets it alone.
START = {"font_name": None, "font_size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "leading": 0.0, "rise": 0.0, "mode": 0.0}
_ALONE = {"char": "Tc", "word": "Tw", "leading": "TL", "rise": "Ts", "mode": "Tr"}
#: Operators that show text, and those that put the place back to the line's start.
SHOWS = ("Tj", "TJ", "'", '"')
PLACES = ("BT", "Tm", "Td", "TD", "T*", "'", '"')


def _number(i: int) -> Column:
    return F.try_variant_get("operands", f"$[{i}]", "double")


def _all(n: int) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"x{i}").isNotNull() for i in range(n)])


def _numbered(ops: DataFrame) -> DataFrame:
    """Operations with their first operands as numbers, scope, parent scope and depth."""
    own = ops.select(*KEY, "op_seq", "op", "operands", *[_number(i).alias(f"x{i}") for i in range(6)])
    w = Window.partitionBy(*KEY).orderBy("op_seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_s", F.sum(F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)).over(up_to))
    own = own.withColumn("depth", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(up_to))).cast("int")).drop("_s")
    opened = F.last(F.when(F.col("op") == "q", F.col("op_seq")), ignorenulls=True).over(Window.partitionBy(*KEY, "depth").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("scope", F.when(F.col("depth") == 0, -1).otherwise(opened))
    return own.withColumn("parent", F.coalesce(F.lag("scope").over(w), F.lit(-1)))


def _set_here() -> dict[str, Column]:
    """What an operation sets of each variable, or null."""
    op = F.col("op")
    out = {k: F.when((op == name) & _all(1), F.col("x0")) for k, name in _ALONE.items()}
    out["scale"] = F.when((op == "Tz") & _all(1), F.col("x0") / 100)
    out["leading"] = F.coalesce(out["leading"], F.when((op == "TD") & _all(2), -F.col("x1")))
    quote = (op == '"') & _all(2) & (F.size(F.try_variant_get("operands", "$", "array<variant>")) >= 3)
    out["word"], out["char"] = F.coalesce(out["word"], F.when(quote, F.col("x0"))), F.coalesce(out["char"], F.when(quote, F.col("x1")))
    name = F.try_variant_get("operands", "$[0]", "string")
    named = (op == "Tf") & F.startswith(name, F.lit("/"))
    out["font_name"] = F.when(named, F.substring(name, F.lit(2), F.char_length(name)))
    out["font_size"] = F.when(named, F.col("x1"))
    return out


def states(ops: DataFrame) -> DataFrame:
    """Each operation with the state that holds after it: file_id, page_index, op_seq, op, operands, depth, ctm and the variables of ``START``."""
    graph.shared_folder(ops.sparkSession)
    own = _numbered(ops).withColumns({f"_{k}": c for k, c in _set_here().items()})
    own = own.withColumn("_m", F.when((F.col("op") == "cm") & _all(6), g.matrix(*[F.col(f"x{i}") for i in range(6)]))).drop(*[f"x{i}" for i in range(6)])
    own = own.checkpoint()
    # running products of each scope's matrices: after round k, of the last 2^k
    scope = Window.partitionBy(*KEY, "scope").orderBy("op_seq")
    so_far = scope.rowsBetween(Window.unboundedPreceding, 0)
    most = own.agg(F.max("depth").alias("depth"), F.max(F.col("op_seq")).alias("n")).first()
    if most["n"] is None:
        most = {"depth": 0}
    products = own.where("_m is not null").select(*KEY, "scope", "op_seq", F.col("_m").alias("p"))
    longest = products.groupBy(*KEY, "scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for k in range((longest - 1).bit_length()):
        before = F.lag("p", 1 << k).over(scope)
        products = products.withColumn("p", F.when(before.isNull(), F.col("p")).otherwise(g.concat(F.col("p"), before)))
    own = own.drop("_m").join(products.drop("scope"), [*KEY, "op_seq"], "left")
    held = [f"_{k}" for k in START]
    own = own.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in [*held, "p"]})
    # what a scope begins with, of its parent and of all above it
    w = Window.partitionBy(*KEY).orderBy("op_seq")
    given = own.withColumns({f"{c}_in": F.lag(c).over(w) for c in [*held, "p"]}).where("op = 'q'")
    one = g.identity()
    given = given.select(*KEY, "scope", F.when(F.col("parent") >= 0, F.col("parent")).alias("up"), *[f"{c}_in" for c in held], F.coalesce("p_in", one).alias("p_in")).checkpoint()
    for _ in range(int(most["depth"] or 0).bit_length()):
        above = given.select(*KEY, F.col("scope").alias("up"), F.col("up").alias("next"), *[F.col(f"{c}_in").alias(f"{c}_up") for c in held], F.col("p_in").alias("p_up"))
        met = given.join(above, [*KEY, "up"], "left")
        further = F.when(F.col("p_up").isNull(), F.col("p_in")).otherwise(g.concat(F.col("p_in"), F.col("p_up")))
        given = met.select(*KEY, "scope", F.col("next").alias("up"), *[F.coalesce(f"{c}_in", f"{c}_up").alias(f"{c}_in") for c in held], further.alias("p_in")).checkpoint()
    out = own.join(given.drop("up"), [*KEY, "scope"], "left")
    ctm = g.concat(F.coalesce("p", one), F.coalesce("p_in", one))
    # what the operators of a scope have set in it goes before what it began with
    values = [F.coalesce(f"_{k}", f"_{k}_in", F.lit(v)).alias(k) for k, v in START.items()]
    return out.select(*KEY, "op_seq", "op", "operands", "depth", ctm.alias("ctm"), *values)


def text_starts(ops: DataFrame) -> DataFrame:
    """Where each shown string begins in user space, for those that no string or number before them has moved along their line: file_id, page_index, op_seq, op, state, x and y."""
    own = states(ops).withColumns({f"x{i}": _number(i) for i in range(6)})
    op, w = F.col("op"), Window.partitionBy(*KEY).orderBy("op_seq").rowsBetween(Window.unboundedPreceding, 0)
    anew = (op == "BT") | ((op == "Tm") & _all(6))
    moved = op.isin("Td", "TD") & _all(2)
    back = op.isin(*PLACES) & (anew | moved | ~op.isin("BT", "Tm", "Td", "TD"))
    own = own.withColumn("_line", F.sum(anew.cast("int")).over(w)).withColumn("_place", F.sum(back.cast("int")).over(w))
    line = Window.partitionBy(*KEY, "_line").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, 0)
    dx = F.sum(F.when(moved, F.col("x0")).otherwise(0.0)).over(line)
    dy = F.sum(F.when(moved, F.col("x1")).when(op.isin("T*", "'", '"'), -F.col("leading")).otherwise(0.0)).over(line)
    base = F.first(F.when(op == "Tm", g.matrix(*[F.col(f"x{i}") for i in range(6)])).otherwise(g.identity())).over(line)
    own = own.withColumn("_m", g.concat(g.translation(dx, dy), F.when(F.col("_line") > 0, base).otherwise(g.identity())))
    # numbers before the first string of an array move it
    items = F.try_variant_get("operands", "$[0]", "array<string>")
    text = lambda x: F.startswith(x, F.lit("("))
    first = F.aggregate(items, F.struct(F.lit(False).alias("found"), F.lit(0.0).alias("sum")), lambda a, x: F.struct((a["found"] | text(x)).alias("found"), (a["sum"] + F.when(a["found"] | text(x), 0.0).otherwise(F.coalesce(x.try_cast("double"), F.lit(0.0)))).alias("sum")))
    given = F.try_variant_get("operands", "$[0]", "string")
    given = F.when(op == '"', F.try_variant_get("operands", "$[2]", "string")).otherwise(given)
    shown = F.when(op == "TJ", F.coalesce(F.exists(items, lambda x: text(x) & (x != "()")), F.lit(False))).otherwise(text(given) & (given != "()"))
    moves = (op == "TJ") & F.exists(items, lambda x: ~text(x) & (x.try_cast("double") != 0))
    own = own.withColumn("_shown", F.coalesce(shown, F.lit(False))).where(op.isin(*SHOWS) & (F.col("_shown") | F.coalesce(moves, F.lit(False))))
    own = own.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, "_place").orderBy("op_seq"))).where("_k = 1 and _shown")
    ahead = F.when(op == "TJ", -first["sum"] / 1000 * F.col("font_size") * F.col("scale")).otherwise(0.0)
    at = g.apply(g.concat(F.col("_m"), F.col("ctm")), ahead, F.col("rise"))
    return own.select(*KEY, "op_seq", "op", "depth", "ctm", *START, at["x"].alias("x"), at["y"].alias("y"))
