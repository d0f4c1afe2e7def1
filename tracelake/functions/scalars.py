"""Column functions of the engine: every one is built from Spark's own functions and stays in generated code."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def nice_round(v: Column) -> Column:
    """The nearest of 1, 2, 5 times a power of ten; 1 for what isn't positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    f = v / power
    return F.when(v <= 0, F.lit(1.0)).otherwise(F.when(f < 1.5, 1.0).when(f < 3.5, 2.0).when(f < 7.5, 5.0).otherwise(10.0) * power)


def decimals(x: Column, places: int) -> Column:
    """Text of x with so many decimals; halves go up, and -0 has no sign."""
    scaled = F.floor(x * 10**places + 0.5).cast("long")
    whole, part = F.floor(F.abs(scaled) / 10**places).cast("string"), F.lpad(F.pmod(F.abs(scaled), F.lit(10**places)).cast("string"), places, "0")
    return F.concat(F.when(scaled < 0, "-").otherwise(""), whole, F.lit("."), part)


def format_scale(microvolts: Column) -> Column:
    small = F.concat(decimals(microvolts, 2), F.lit(" µV"))
    mid = F.concat(F.floor(microvolts + 0.5).cast("string"), F.lit(" µV"))
    return F.when(microvolts < 1, small).when(microvolts < 1000, mid).otherwise(F.concat(decimals(microvolts / 1000, 1), F.lit(" mV")))


def scale_bar(slot_uv: Column, slot_height: Column, plot_x1: Column, plot_y0: Column, plot_height: Column) -> Column:
    """Struct (uv, px, x, y_bottom, y_top) of the bar that shows about half a slot; null where it would be shorter than 8 pixels."""
    uv = nice_round(slot_uv * 0.5)
    px = uv / slot_uv * slot_height
    bottom = plot_y0 + plot_height - 12
    return F.when((slot_uv > 0) & (px >= 8), F.struct(uv.alias("uv"), px.alias("px"), (plot_x1 + 18).alias("x"), bottom.alias("y_bottom"), (bottom - px).alias("y_top")))


def gain_readout(gain: Column, slot_uv: Column) -> Column:
    """Text of the gain, with the size of a slot where it is known."""
    factor = F.concat(decimals(gain, 2), F.lit("×"))
    return F.when((slot_uv > 0) & ~F.isnan(slot_uv), F.concat(factor, F.lit(" (~"), format_scale(slot_uv), F.lit("/slot)"))).otherwise(factor)


def cursor(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column, n_channels: Column, n_samples: Column, start: Column, fs: Column) -> Column:
    """Struct (t, channel, sample) under a pointer, clamped to the plot."""
    share = F.greatest(F.lit(0.0), F.least(width, x - left)) / width
    channel = clamp(F.floor(F.greatest(F.lit(0.0), F.least(height, y - top)) / (height / n_channels)), F.lit(0), n_channels - 1)
    sample = clamp(F.floor(share * (n_samples - 1) + 0.5), F.lit(0), n_samples - 1)
    return F.when((width > 0) & (height > 0) & (n_channels > 0), F.struct((start + share * n_samples / fs).alias("t"), channel.alias("channel"), sample.alias("sample")))


def hhmmss(seconds: Column) -> Column:
    """Time of day, modulo 24 hours."""
    s = F.pmod(F.floor(seconds), F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))


def second_of_day(iso: Column) -> Column:
    """Seconds since midnight of the time in an ISO text; null if there is none."""
    part = lambda k: F.regexp_extract(iso, r"T(\d{2}):(\d{2}):(\d{2})", k).cast("int")
    return F.when(iso.rlike(r"T\d{2}:\d{2}:\d{2}"), part(1) * 3600 + part(2) * 60 + part(3))


def edf_start(date: Column, time: Column) -> Column:
    """ISO start of a recording from dd.mm.yy and hh.mm.ss; years below 85 are 20yy."""
    d = lambda k: F.regexp_extract(date, r"^(\d{2})\.(\d{2})\.(\d{2})$", k)
    year = d(3).cast("int")
    made = F.concat(F.when(year < 85, year + 2000).otherwise(year + 1900).cast("string"), F.lit("-"), d(2), F.lit("-"), d(1), F.lit("T"), F.replace(time, F.lit("."), F.lit(":")))
    return F.when(date.rlike(r"^\d{2}\.\d{2}\.\d{2}$") & time.rlike(r"^\d{2}\.\d{2}\.\d{2}$"), made)


def micro_utc(micros: Column, earliest: int = 0, latest: int = 4_102_444_800_000_000) -> Column:
    """Timestamp of microseconds since 1970; null outside the plausible bounds."""
    return F.when((micros > earliest) & (micros < latest), F.timestamp_micros(micros))


def bids_cell(cell: Column) -> Column:
    """Null for an empty cell or n/a."""
    return F.when(~F.lower(F.trim(cell)).isin("", "n/a"), F.trim(cell))


def float_prefix(text: Column) -> Column:
    """The number that a text begins with; null if it doesn't begin with one."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def round_half_away(x: Column, low: int = -(2**31) + 1, high: int = 2**31 - 2) -> Column:
    return F.least(F.greatest(F.signum(x) * F.floor(F.abs(x) + 0.5), F.lit(float(low))), F.lit(float(high))).cast("long")


def sign_extend24(raw: Column) -> Column:
    """Two's complement value of the low 24 bits."""
    return F.shiftright(F.shiftleft(raw.cast("int"), 8), 8)


def duration_class(declared: Column, measured: Column) -> Column:
    """ok, epoched (declared is a whole multiple above 1), or mismatch; ratios within 0.01 count as whole."""
    ratio = declared / measured
    return F.when(F.abs(ratio - 1) < 0.01, "ok").when((F.floor(ratio + 0.5) > 1) & (F.abs(ratio - F.floor(ratio + 0.5)) < 0.01), "epoched").otherwise("mismatch")


def unit(text: Column) -> Column:
    """Display form of a unit: µV, mV, V, au, or the text itself; µV where there is none."""
    t = F.lower(text)
    starts = lambda *heads: F.lit(False) if not heads else F.startswith(t, F.lit(heads[0])) | starts(*heads[1:])
    out = F.when(text.isNull() | (text == ""), "µV").when(t.isin("µv", "uv", "microv") | starts("microvolt"), "µV").when((t == "mv") | starts("millivolt"), "mV")
    return out.when((t == "v") | starts("volt"), "V").when((t == "au") | starts("arb"), "au").otherwise(text)


def cleaned(message: Column) -> Column:
    """A message without terminal colours, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(message, r"\x1b\[[0-9;]*m", ""), r"\s+", " "))


#: Classes of audit rows that didn't pass: class, extension, verdict, pattern of the message (any case); null asks nothing. The
#: first that holds counts. Fixed values.
FAILURES = [
    ("format-CTF-residual", "ds", None, None),
    ("format-FIFF-large", "fif", None, r"(fetchBuffer|exceeds .* cap|over .*MB|200 ?MB)"),
    ("format-FIFF-no-raw-block", "fif", None, r"FIFFB_RAW_DATA|no .*raw.*block|events\/projections\/annotations only"),
    ("format-EEGLAB-large", "set", None, r"200 ?MB|inline .* exceeds|cap on inline"),
    ("format-EEGLAB-v73-renamed-fdt", "set", None, r"v?7\.3|HDF5|jsfive|renamed .*fdt|fdt .*not found"),
    ("network-flake", None, "console-error", r"5\d\d|net::ERR|TLS|ECONNRESET|EAI_AGAIN"),
    ("timeout-cold-cdn", None, "timeout", None),
    ("timeout-cold-cdn", None, "render-fail", r"stage-caption never visible"),
]


def failure_class(ext: Column, verdict: Column, message: Column) -> Column:
    """Null for a row that passed, else the class of the first rule that holds, else `unknown`."""
    out = F.when(verdict == "pass", F.lit(None).cast("string"))
    for name, of_ext, of_verdict, pattern in FAILURES:
        asked = [ext == of_ext] * (of_ext is not None) + [verdict == of_verdict] * (of_verdict is not None) + [F.coalesce(message, F.lit("")).rlike(f"(?i){pattern}")] * (pattern is not None)
        holds = asked[0]
        for a in asked[1:]:
            holds = holds & a
        out = out.when(holds, name)
    return out.otherwise("unknown")


def highpass(fs: Column, cutoff: Column) -> Column:
    """Struct (b0, b1, b2, a1, a2) of a second-order Butterworth high-pass."""
    return _biquad(fs, cutoff, F.lit(math.sqrt(0.5)), lambda c, a: ((1 + c) / 2, -(1 + c), (1 + c) / 2))


def lowpass(fs: Column, cutoff: Column) -> Column:
    return _biquad(fs, cutoff, F.lit(math.sqrt(0.5)), lambda c, a: ((1 - c) / 2, 1 - c, (1 - c) / 2))


def notch(fs: Column, centre: Column, q: Column | float = 30.0) -> Column:
    return _biquad(fs, centre, F.lit(q) if isinstance(q, (int, float)) else q, lambda c, a: (F.lit(1.0), -2 * c, F.lit(1.0)))


def _biquad(fs: Column, f: Column, q: Column, numerator) -> Column:
    w0 = 2 * math.pi * f / fs
    c, alpha = F.cos(w0), F.sin(w0) / (2 * q)
    a0 = 1 + alpha
    b0, b1, b2 = numerator(c, alpha)
    return F.struct((b0 / a0).alias("b0"), (b1 / a0).alias("b1"), (b2 / a0).alias("b2"), (-2 * c / a0).alias("a1"), ((1 - alpha) / a0).alias("a2"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once for each row however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Steps of a time axis in seconds, and the pixels that a label needs. Fixed values.
STEPS, LABEL_PX = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0], 44


def time_axis(t0: Column, t1: Column, width: Column) -> Column:
    """Struct (step, major, minor) of a time axis: multiples of the greatest step that is no more than a seventh of the window,
    widened while labels wouldn't fit the pixels and at least two are left; and between them those of a fifth of the step."""
    span = t1 - t0
    crowded = lambda step, wider: ((span / step + 1) * LABEL_PX > width) & F.coalesce(F.lit(wider) <= span / 2 + 1e-9, F.lit(False))
    fits = [F.when(F.coalesce(F.lit(wider) > span / 7, F.lit(True)) & ~crowded(step, wider), step) for step, wider in itertools.pairwise(STEPS)]
    places = lambda v, step: F.sequence(F.ceil(v["t0"] / step), F.floor((v["t1"] + 1e-9) / step))
    any_of = lambda v, step: F.when(F.ceil(v["t0"] / step) <= F.floor((v["t1"] + 1e-9) / step), places(v, step)).otherwise(F.array().cast("array<bigint>"))

    def axis(v: Column) -> Column:
        step = v["step"]
        minor = F.filter(any_of(v, step / 5), lambda k: k % 5 != 0)
        return F.struct(step.alias("step"), F.transform(any_of(v, step), lambda k: k * step).alias("major"), F.transform(minor, lambda k: k * (step / 5)).alias("minor"))

    return once(F.struct(t0.alias("t0"), t1.alias("t1"), F.coalesce(*fits, F.lit(STEPS[-1])).alias("step")), axis)


#: Frames whose first axis points ahead and whose second points left. Fixed values.
ALS = "^(ctf|4dbti|kityokogawa|eeglab|eeglab-hj)$"


def display_point(x: Column, y: Column, z: Column, space: Column, units: Column) -> Column:
    """Struct of millimetres in the RAS frame: an ALS frame is turned (-y, x, z); m and cm are scaled, other units are not."""
    als = F.coalesce(space.rlike(f"(?i){ALS}"), F.lit(False))
    scale = F.when(units == "m", 1000.0).when(units == "cm", 10.0).otherwise(1.0)
    return F.struct((F.when(als, -y).otherwise(x) * scale).alias("x"), (F.when(als, x).otherwise(y) * scale).alias("y"), (z * scale).alias("z"))


def to_head(matrix: Column, x: Column, y: Column, z: Column) -> Column:
    """Struct of a point moved by a 4 x 4 matrix, an array of 16 numbers row by row."""
    m = lambda i: F.get(matrix, F.lit(i))
    row = lambda r: m(4 * r) * x + m(4 * r + 1) * y + m(4 * r + 2) * z + m(4 * r + 3)
    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def scalp_position(x: Column, y: Column, z: Column) -> Column:
    """Struct (u, v): azimuthal equidistant projection of a direction, 1 at the equator."""
    n = F.sqrt(x * x + y * y + z * z)
    r = F.acos(F.greatest(F.least(z / n, F.lit(1.0)), F.lit(-1.0))) / (math.pi / 2)
    azimuth = F.atan2(y, x)
    return F.struct((r * F.cos(azimuth)).alias("u"), (r * F.sin(azimuth)).alias("v"))


def rotated(x: Column, y: Column, z: Column, yaw: float, pitch: float) -> Column:
    """Struct (px, py, depth): yaw about the vertical axis, then pitch, seen orthographically."""
    cy, sy, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    x1, z1 = x * cy + z * sy, z * cy - x * sy
    return F.struct(x1.alias("px"), (y * cp - z1 * sp).alias("py"), (y * sp + z1 * cp).alias("depth"))


ENTITY = r"(?:^|[_/])(sub|ses|task|acq|run|split|space|desc|rec|proc)-([A-Za-z0-9+]+)"


def entities(path: Column) -> Column:
    """Map of the entities in a BIDS path; the first value of a key counts."""
    keys = F.regexp_extract_all(path, F.lit(ENTITY), F.lit(1))
    values = F.regexp_extract_all(path, F.lit(ENTITY), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.map_from_entries(F.filter(F.transform(pairs, lambda p, i: F.when(F.array_position(keys, p["k"]) == i + 1, F.struct(p["k"], p["v"]))), lambda p: p.isNotNull()))


def is_dataset_id(text: Column) -> Column:
    return text.rlike(r"^(ds|nm|on|xx)\d{6}$")
