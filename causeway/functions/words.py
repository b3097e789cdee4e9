"""Column functions on log words: tags, ids, wall-clock times and payloads. Unsigned 32-bit words are longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
MAX_ID = (1 << 30) - 1
INTERNAL_IDS = 256
MAX_USER_EVENT = MAX_ID - INTERNAL_IDS
CLOCK, PAYLOAD, UNPAIRED, PAIRED = 0x80000000, 0x40000000, 0xC0000000, 0xE0000000
TOP2, TOP3, WORD = 0xC0000000, 0xE0000000, 0xFFFFFFFF
MAX_NS = (1 << 61) - 1
INTERNAL_EVENTS = {
    "produced_report": MAX_ID - 1,
    "items_missed": MAX_ID - 2,
    "clock_overflowed": MAX_ID - 3,
    "num_clocks_overflowed": MAX_ID - 4,
    "insufficient_report_buffer": MAX_ID - 5,
    "probe_initialised": MAX_ID - 6,
    "invalid_next_epoch": MAX_ID - 7,
    "time_only": MAX_ID - 8,
}


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def _or(c: Column, mask: int) -> Column:
    return c.bitwiseOR(F.lit(mask).cast("long"))


def is_clock(w: Column) -> Column:
    return _and(w, TOP2) == CLOCK


def has_payload(w: Column) -> Column:
    return _and(w, TOP2) == PAYLOAD


def is_time(w: Column) -> Column:
    return _and(w, TOP2) == TOP2


def is_paired_time(w: Column) -> Column:
    return _and(w, TOP3) == PAIRED


def kind(w: Column) -> Column:
    """event, event_payload, clock, time (unpaired) or paired_time; right for the first word of an entry only."""
    return F.when(is_paired_time(w), "paired_time").when(is_time(w), "time").when(is_clock(w), "clock").when(has_payload(w), "event_payload").otherwise("event")


def event_word(event_id: Column) -> Column:
    return event_id.cast("long")


def payload_word(event_id: Column) -> Column:
    return _or(event_id.cast("long"), PAYLOAD)


def clock_word(probe_id: Column) -> Column:
    return _or(probe_id.cast("long"), CLOCK)


def time_words(ns: Column, paired: bool = True) -> list[Column]:
    """The tagged high word and the low word."""
    return [_or(F.shiftright(ns, 32), PAIRED if paired else UNPAIRED), _and(ns, WORD)]


def as_probe_id(w: Column) -> Column:
    """Clears the clock bit only."""
    return _and(w, 0x7FFFFFFF)


def as_event_id(w: Column) -> Column:
    """Clears the payload bit only; null where what is left is no event id."""
    x = _and(w, WORD ^ PAYLOAD)
    return F.when(x.between(1, MAX_ID), x)


def as_time_ns(high: Column, low: Column) -> Column:
    return F.shiftleft(_and(high, 0x1FFFFFFF), 32) + low


def probe_id(x: Column) -> Column:
    """A number as a probe id, null if out of range."""
    y = x.try_cast("long")
    return F.when(y.between(1, MAX_ID), y)


def event_id(x: Column, internal: bool = True) -> Column:
    """A number as an event id, null if out of range."""
    y = x.try_cast("long")
    return F.when(y.between(1, MAX_ID if internal else MAX_USER_EVENT), y)


def is_internal(x: Column) -> Column:
    return x.between(MAX_USER_EVENT + 1, MAX_ID)


def recording_error(event: Column, ns: Column | None = None) -> Column:
    """The error of a checked recording call, the event id first; null if it is fine."""
    bad = F.when(event_id(event).isNull(), "InvalidEventId")
    return bad if ns is None else bad.when(ns.isNotNull() & valid_ns(ns).isNull(), "InvalidWallClockTime")


def valid_ns(ns: Column) -> Column:
    """Nanoseconds, null beyond 61 bits."""
    return F.when(ns.between(0, MAX_NS), ns)


def truncated_ns(ns: Column) -> Column:
    return _and(ns, MAX_NS)


def ns_parts(ns: Column) -> tuple[Column, Column]:
    """Low and high 32 bits."""
    return _and(ns, WORD), F.shiftright(ns, 32)


def whole(ns: Column, unit_ns: int) -> Column:
    """Whole units in a non-negative time: integer division."""
    return F.floor((ns - ns % F.lit(unit_ns).cast("long")) / F.lit(unit_ns)) if unit_ns == 1 else F.call_function("div", ns, F.lit(unit_ns).cast("long"))


def unspecified(resolution_ns: Column) -> Column:
    """The resolution of a probe's times is not known."""
    return resolution_ns == 0


def local_only(clock: Column) -> Column:
    """The wall clock is the probe's own and not to be compared with others."""
    return clock == 0


def comparable(clock_a: Column, clock_b: Column, probe_a: Column, probe_b: Column) -> Column:
    """Times can be compared: the same wall clock that is not local, or the same probe."""
    return ((clock_a == clock_b) & ~local_only(clock_a)) | (probe_a == probe_b)


def _signed(raw: Column, bits: int) -> Column:
    low = _and(raw, (1 << bits) - 1)
    return F.when(low >= 1 << (bits - 1), low - F.lit(1 << bits).cast("long")).otherwise(low)


def _float32(raw: Column) -> Column:
    e, m = _and(F.shiftright(raw, 23), 255), _and(raw, (1 << 23) - 1).cast("double")
    sign = F.when(raw >= 1 << 31, -1.0).otherwise(1.0)
    part = m / float(1 << 23)
    special = F.when(m == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(e == 255, special).when(e == 0, sign * part * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise(sign * (part + 1.0) * F.pow(F.lit(2.0), e.cast("double") - 127.0))


def payload(raw: Column, as_type: str) -> Column:
    """The payload word as i8, u8, i16, u16, i32, u32, bool or f32."""
    if as_type == "bool":
        return raw != 0
    if as_type == "f32":
        return _float32(raw)
    bits = int(as_type[1:])
    return _signed(raw, bits) if as_type[0] == "i" else _and(raw, (1 << bits) - 1)


def payload_raw(value: Column) -> Column:
    """A whole number or boolean as its payload word: two's complement in 32 bits."""
    return _and(value.cast("long"), WORD)


def filled(description: Column, raw: Column) -> Column:
    """The description with the payload in its placeholder."""
    return F.replace(description, F.lit("{}"), raw.cast("string"))
