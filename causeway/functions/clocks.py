"""Column functions on logical clocks (probe_id, epoch, ticks); epoch and ticks are unsigned 16-bit numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: epochs from NEAR_MAX on are followed by those up to NEAR_MIN.
TOP = 65535
NEAR_MAX, NEAR_MIN = 65532, 3


def pack(epoch: Column, ticks: Column) -> Column:
    return epoch.cast("long") * 65536 + ticks


def epoch_of(word: Column) -> Column:
    return F.shiftright(word, 16)


def ticks_of(word: Column) -> Column:
    return word.bitwiseAND(F.lit(TOP).cast("long"))


def following(epoch: Column, ticks: Column) -> tuple[Column, Column]:
    """The clock one tick on: ticks start again at 1, epochs at 0."""
    wraps = ticks == TOP
    return F.when(wraps, (epoch + 1) % 65536).otherwise(epoch), F.when(wraps, 1).otherwise(ticks + 1)


def preceding(epoch: Column, ticks: Column) -> tuple[Column, Column]:
    """One tick back; from ticks 0 the epoch goes back and ticks stay 0, so it does not undo `following`."""
    first = ticks == 0
    return F.when(first, F.greatest(epoch - 1, F.lit(0))).otherwise(epoch), F.when(first, 0).otherwise(ticks - 1)


def at_ordinal(n: Column) -> tuple[Column, Column]:
    """(epoch, ticks) after n ticks from (0, 0), for a probe whose restarts are not tracked."""
    before = F.greatest(n - 1, F.lit(0))
    return F.call_function("div", before, F.lit(TOP).cast("long")) % 65536, F.when(n == 0, 0).otherwise(before % TOP + 1)


def compare(id_a: Column, epoch_a: Column, ticks_a: Column, id_b: Column, epoch_b: Column, ticks_b: Column) -> Column:
    """-1, 0 or 1 by (epoch, ticks) without wrapping; null across probes."""
    a, b = pack(epoch_a, ticks_a), pack(epoch_b, ticks_b)
    return F.when(id_a == id_b, F.when(a == b, 0).when(a > b, 1).otherwise(-1))


def later(epoch_a: Column, ticks_a: Column, epoch_b: Column, ticks_b: Column) -> Column:
    """a supersedes b: greater, or just after the wrap with b just before it. Both directions can hold across the wrap."""
    same = (epoch_a == epoch_b) & (ticks_a == ticks_b)
    wrapped = (epoch_b >= NEAR_MAX) & (epoch_a <= NEAR_MIN)
    return ~same & (wrapped | (pack(epoch_a, ticks_a) > pack(epoch_b, ticks_b)))


def instant_compare(id_a: Column, clock_a: Column, count_a: Column, id_b: Column, clock_b: Column, count_b: Column) -> Column:
    """-1, 0 or 1 by (packed clock, event count); null across probes."""
    a, b = F.struct(clock_a.alias("c"), count_a.alias("n")), F.struct(clock_b.alias("c"), count_b.alias("n"))
    return F.when(id_a == id_b, F.when(a == b, 0).when(a > b, 1).otherwise(-1))


def added(epoch: Column, n: Column) -> tuple[Column, Column]:
    """(wrapped sum, whether it wrapped)."""
    return F.pmod(epoch + n, F.lit(65536)), epoch + n > TOP
