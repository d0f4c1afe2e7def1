"""Names and addresses of recordings: URLs taken apart and built, files told apart, requests checked. Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of recordings, extensions that a reader takes, and companions that are never opened by themselves. Fixed values.
SUFFIXES = "eeg|ieeg|emg|meg|nirs"
READABLE = ["edf", "bdf", "set", "vhdr", "fif", "fiff", "snirf", "ds", "mefd", "con", "sqd", "nwb", "raw", "bti", "kdf"]
COMPANIONS = ["fdt", "vmrk", "eeg", "json", "tsv"]
#: Forms of a recording's URL, the first that fits counts: pattern with folder, prefix, suffix; extension, null for that of the name.
FORMS = [
    (rf"^(.*/)([^/]+?)_({SUFFIXES})\.ds/\2_\3\.meg4$", "ds"),
    (rf"^(.*/)([^/]+?)_({SUFFIXES})\.mefd/", "mefd"),
    (rf"^(.*/)([^/]+?)_({SUFFIXES})/(?:config|c,rf[A-Za-z0-9.]+)$", "bti"),
    (rf"^(.*/)([^/]+?)_({SUFFIXES})\.([A-Za-z0-9+]+)$", None),
]
BARE = r"^(.*/)([^/]+)\.(edf|bdf|set|vhdr|fif|fiff|snirf|con|sqd|nwb|raw|kdf)$"
#: Greatest samples of a window, characters of a request's name, and sizes of a recording. Fixed values.
WINDOW_SAMPLES, NAME_CHARS, SAMPLES, CHANNELS, TRIALS = 1 << 28, 64, 1 << 30, 4096, 4096


def recording_url(url: Column) -> Column:
    """Struct (dir, prefix, suffix, ext) of a recording's URL; null for what isn't one. Bundles are named by their folder, so that
    sidecars are sought beside it."""
    part = lambda pattern, k: F.regexp_extract(url, pattern, k)
    out = F.when(F.lit(False), F.struct(url.alias("dir"), url.alias("prefix"), url.alias("suffix"), url.alias("ext")))
    for pattern, ext in FORMS:
        own = F.lit(ext) if ext else F.lower(part(pattern, 4))
        out = out.when(url.rlike(pattern), F.struct(part(pattern, 1).alias("dir"), part(pattern, 2).alias("prefix"), part(pattern, 3).alias("suffix"), own.alias("ext")))
    bare = f"(?i){BARE}"
    return out.when(url.rlike(bare), F.struct(part(bare, 1).alias("dir"), part(bare, 2).alias("prefix"), F.lit("eeg").alias("suffix"), F.lower(part(bare, 3)).alias("ext")))


def recording_path(dataset: Column, sub: Column, ses: Column, task: Column, acq: Column, run: Column, ext: Column, suffix: Column) -> Column:
    """Path of a recording within its bucket; null without a dataset or subject. A missing extension is `set`, a missing suffix `eeg`."""
    suffix, ext = F.lower(F.coalesce(suffix, F.lit("eeg"))), F.lower(F.coalesce(ext, F.lit("set")))
    named = lambda key, value: F.concat(F.lit(f"{key}-"), F.when(value != "", value))
    folder = F.concat_ws("/", dataset, named("sub", sub), named("ses", ses), suffix)
    name = F.concat(F.concat_ws("_", named("sub", sub), named("ses", ses), named("task", task), named("acq", acq), named("run", run)), F.lit("_"), suffix)
    file = F.when(ext == "ds", F.concat(name, F.lit(".ds/"), name, F.lit(".meg4"))).otherwise(F.concat(name, F.lit("."), ext))
    return F.when((dataset != "") & (sub != ""), F.concat(folder, F.lit("/"), file))


def is_recording_name(name: Column) -> Column:
    return name.rlike(rf"(?i)_({SUFFIXES})\.({'|'.join(READABLE)})$")


def primary_ext(key: Column) -> Column:
    """Extension of a file that is opened by itself; null for companions, sidecars, Finder's doubles and other files."""
    name = F.substring_index(key, "/", -1)
    ext = F.lower(F.substring_index(name, ".", -1))
    skipped = F.startswith(name, F.lit("._")) | F.substring_index(name, ".", -1).isin(COMPANIONS)
    return F.when(~skipped, F.when(ext == "meg4", "ds").when(ext.isin(READABLE), ext))


def compatible(candidate: Column, context: Column) -> Column:
    """Whether every entity of a candidate, `space` apart, is the context's too. Both are maps of entities."""
    return F.forall(F.map_entries(candidate), lambda e: (e["key"] == "space") | F.coalesce(F.try_element_at(context, e["key"]) == e["value"], F.lit(False)))


def allowed_protocol(url: Column) -> Column:
    """http, https or a relative address; no other scheme, and none that takes the page's own."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.coalesce((url != "") & ~F.startswith(url, F.lit("//")) & ((scheme == "") | scheme.isin("http", "https")), F.lit(False))


def valid_request_name(name: Column) -> Column:
    return F.coalesce(F.length(name).between(1, NAME_CHARS), F.lit(False))


def valid_window(start: Column, n: Column) -> Column:
    """Finite, not before the beginning, not empty and not beyond WINDOW_SAMPLES."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return finite(start) & finite(n) & (start >= 0) & (n > 0) & (n <= WINDOW_SAMPLES)


def valid_sizes(channels: Column, points: Column, trials: Column) -> Column:
    """Whole numbers of channels, points and trials within their bounds, and so is what they come to."""
    within = lambda x, most: (x == F.floor(x)) & (x >= 1) & (x <= most)
    return F.coalesce(within(channels, CHANNELS) & within(points, SAMPLES) & within(trials, TRIALS) & (channels.cast("double") * points * trials <= SAMPLES), F.lit(False))


def safe_companion(name: Column) -> Column:
    """A companion's name that stays in its folder: no separator, no leading dot, no scheme."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\]|^\.|^(?i)[a-z]+:"), F.lit(False))


def size_error(size: Column, unit: Column, label: Column) -> Column:
    """What is wrong with the size of a file that holds whole units; null if nothing is."""
    return F.when(unit <= 0, F.concat(label, F.lit(": a record has no bytes"))).when(size % unit != 0, F.concat(label, F.lit(": "), size.cast("string"), F.lit(" bytes are no multiple of "), unit.cast("string")))


def optode_label(index: Column, source: Column, detector: Column, wavelength: Column) -> Column:
    """S1D2-760nm, without the wavelength where it isn't known; Ch and the index without source or detector."""
    length = F.coalesce(F.concat(F.lit("-"), F.floor(wavelength + 0.5).cast("string"), F.lit("nm")), F.lit(""))
    return F.when(source.isNotNull() & detector.isNotNull(), F.concat(F.lit("S"), source.cast("string"), F.lit("D"), detector.cast("string"), length)).otherwise(F.concat(F.lit("Ch"), index.cast("string")))


def number_type(dtype: Column) -> Column:
    """Struct (kind, bytes) of a little-endian number type such as <f4; null for others."""
    pattern = r"^([<>=!@|])?([iuf])(\d+)$"
    kind, size = F.regexp_extract(dtype, pattern, 2), F.regexp_extract(dtype, pattern, 3).try_cast("int")
    known = ((kind == "f") & size.isin(4, 8)) | (kind.isin("i", "u") & size.isin(1, 2, 4))
    return F.when(known & ~F.regexp_extract(dtype, pattern, 1).isin(">", "!"), F.struct(kind.alias("kind"), size.alias("bytes")))


#: Kinds of sensors in FIFF channel tables, with the group and type that they are shown under. Fixed values.
FIFF_SENSORS = {1: ("MEG", "MEG", "FIFF device"), 301: ("MEG", "MEGREF", "FIFF device"), 2: ("EEG", "EEG", "CapTrak")}


def fiff_sensor(kind: Column, x: Column, y: Column, z: Column) -> Column:
    """Struct (sensors, type, space) of a channel that has a place; null for other kinds, for places that aren't finite and for
    the origin, which stands for none."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("sensors"), F.lit("").alias("type"), F.lit("").alias("space")))
    for k, (group, name, space) in FIFF_SENSORS.items():
        out = out.when(kind == k, F.struct(F.lit(group).alias("sensors"), F.lit(name).alias("type"), F.lit(space).alias("space")))
    finite = F.lit(True)
    for c in (x, y, z):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite & ((x != 0) | (y != 0) | (z != 0)), out)


def run_seconds(log: Column) -> Column:
    """Milliseconds between the START and END lines of a run's log."""
    at = lambda word: F.unix_millis(F.try_to_timestamp(F.regexp_extract(log, rf"(?m)^{word} (\S+)$", 1)))
    return at("END") - at("START")


def headline(report: Column) -> Column:
    """Struct (passed, total, percent) of a report's headline; null without one."""
    pattern = r"\*\*(\d+) of (\d+) datasets \(([\d.]+)%\)"
    part = lambda k: F.regexp_extract(report, pattern, k)
    return F.when(report.rlike(pattern), F.struct(part(1).cast("long").alias("passed"), part(2).cast("long").alias("total"), part(3).cast("double").alias("percent")))
