"""Keys, labels and formats of reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_token(c: Column, default: str = "default") -> Column:
    """Other characters than letters, digits, dot, underscore and hyphen become one underscore; none at the ends."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(t != "", t).otherwise(F.lit(default))


def slug(c: Column, prefix: str) -> Column:
    """The prefix, an underscore and the first twelve hex digits of the SHA-1 of a canonical text."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(c), 1, 12))


def relative(path: Column, base: str) -> Column:
    """Forward slashes, without the base folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit(base + "/")), F.substr(p, F.lit(len(base) + 2))).otherwise(p)


def stem(path: Column) -> Column:
    """A file's name without its folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def model_variant(paths: list[Column], fallback: Column) -> Column:
    """The cleaned stems of the paths that aren't null or blank, joined by two underscores; the cleaned fallback where there is none."""
    stems = F.filter(F.array(*[stem(p) for p in paths]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(stems) > 0, F.array_join(F.transform(stems, lambda x: clean_token(x)), "__")).otherwise(clean_token(fallback))


def rng_seed(seed: int, *tokens) -> Column:
    """A seed of its own for each combination of tokens: the common seed and the CRC-32 of the tokens joined by slashes."""
    named = [t if isinstance(t, Column) else F.col(t) for t in tokens]
    return F.lit(seed) + F.crc32(F.concat_ws("/", *[t.cast("string") for t in named]).cast("binary"))


def _decimals(x: Column, n: int) -> Column:
    """n decimals of the double as it is, as C prints it: its shortest decimal form, which formatter and rounding take, may be a half where the double is
    none. Halves go to the even digit. The fraction is taken in two parts, so that its products with a power of ten are exact."""
    a, scale, cut = F.abs(x), float(10**n), float(1 << 26)
    whole = F.floor(a)
    high = F.floor((a - whole) * cut) / cut
    units = F.floor(high * scale)
    over, rest = high * scale - units - 0.5, (a - whole - high) * scale
    units += ((over > -rest) | ((over == -rest) & ((units if n else whole) % 2 == 1))).cast("long")
    carried = whole + F.when(units >= 10**n, 1).otherwise(0)
    text = F.format_string(f"%s%d.%0{n}d", F.when(x < 0, "-").otherwise(""), carried, units % 10**n) if n else F.format_string("%s%d", F.when(x < 0, "-").otherwise(""), carried)
    whole_text = F.concat(F.when(x < 0, "-").otherwise(""), _digits(a), F.lit("." + "0" * n if n else ""))
    return F.when(a < float(1 << 53), text).when(a < 1e38, whole_text).otherwise(F.format_string(f"%.{n}f", F.bround(x, n)))


def _digits(a: Column) -> Column:
    """All digits of a double between 2^53 and 10^38, which is a whole number of at most 55 bits times a power of two; its shortest decimal form stops after 17."""
    e = F.greatest(F.lit(0), (F.floor(F.log2(a)) - 53).cast("int"))
    # 2^e in two parts of at most 40 bits
    low, high = (F.pow(F.lit(2.0), x).cast("long").cast("decimal(13,0)") for x in (F.least(e, F.lit(40)), F.greatest(e - 40, F.lit(0))))
    return ((a / F.pow(F.lit(2.0), e)).cast("long").cast("decimal(17,0)") * low * high).cast("string")




def byte_size(n: Column) -> Column:
    """1.50 MB and the like: two decimals, powers of 1024, from B to TB."""
    x = n.cast("double")
    sized = lambda k, unit: F.concat(_decimals(x / 1024.0**k, 2), F.lit(f" {unit}"))
    return F.when(x < 1024, sized(0, "B")).when(x < 1024.0**2, sized(1, "KB")).when(x < 1024.0**3, sized(2, "MB")).when(x < 1024.0**4, sized(3, "GB")).otherwise(sized(4, "TB"))


def duration(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; whole seconds, cut off; below zero counts as zero."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def ppm_cell(percent: Column) -> Column:
    """A rate in percent: below 0.1 with four decimals and in parts per million, else with three decimals."""
    small = F.concat(_decimals(percent, 4), F.lit("% ("), _decimals(percent * 1e4, 0), F.lit(" ppm)"))
    return F.when(percent < 0.1, small).otherwise(F.concat(_decimals(percent, 3), F.lit("%")))


#: Least rank-1 rate in percent, bytes that a feature stays below, least frames a second.
LEAST_RANK1, BELOW_BYTES, LEAST_FPS = 90, 1024, 30


def verdict(rank1: Column, feature_bytes: Column, fps: Column) -> Column:
    """What a run reaches of the specification: rank-1 rate, feature size and speed."""
    rate = F.when(rank1 >= LEAST_RANK1, "TAR(rank-1) PASS").otherwise(f"TAR(rank-1) below {LEAST_RANK1}%")
    size = F.when((feature_bytes > 0) & (feature_bytes < BELOW_BYTES), "feature PASS <1KB").otherwise("feature FAIL >=1KB")
    speed = F.when(fps.isNull(), "fps n/a").when(fps >= LEAST_FPS, f">={LEAST_FPS}fps PASS").otherwise(f"<{LEAST_FPS}fps")
    return F.concat_ws("; ", rate, size, speed)


#: The family tags that reports of a model carry.
FAMILIES = {
    "ArcFace": ("arcface_buffalo_s",), "ArcFace MobileNet INT8": ("arcface_mobilenet_int8", "arcface_buffalo_s_int8"), "MobileFaceNet": ("yunet_mobilefacenet",), "EdgeFace": ("edgeface",),
    "LBPH": ("lbph",), "Eigenfaces": ("eigenfaces",), "Fisherfaces": ("fisherfaces",), "Hybrid": ("hybrid",),
}


def of_model(model: str, family: Column, variant: Column) -> Column:
    """Whether a report belongs to a model: by family tag; the plain model and its quantized one are told apart by `int8`
    in the variant or at the end of the tag."""
    tag, name = F.lower(F.trim(family)), F.lower(F.trim(variant))
    own = tag.isin(*FAMILIES.get(model, ()))
    quantized = F.contains(name, F.lit("int8")) | F.endswith(tag, F.lit("_int8"))
    return F.coalesce(own & quantized if model == "ArcFace MobileNet INT8" else own & ~quantized if model == "ArcFace" else own, F.lit(False))


def report_variant(path: Column, model: str, fallback: str = "default") -> Column:
    """The variant that a report's file name tells: without one ending and without the model's family tag."""
    name = F.lower(F.trim(stem(path)))
    ending = lambda e: (F.endswith(name, F.lit(e)), F.substr(name, F.lit(1), F.length(name) - len(e)))
    cut = name
    for e in ("_report", "_eval", "_evaluation"):
        cut = F.when(*ending(e)).otherwise(cut)
    tags = {re.sub("[^a-z0-9]+", "_", t.lower()).strip("_") for t in (model, *FAMILIES.get(model, ()))}
    out = cut
    for t in sorted(tags, key=lambda t: (len(t), t)):
        out = F.when(cut == t, F.lit("")).when(F.startswith(cut, F.lit(t + "_")), F.regexp_replace(F.substr(cut, F.lit(len(t) + 2)), "^_+|_+$", "")).otherwise(out)
    return F.when(out == "", F.lit(fallback)).otherwise(F.coalesce(out, F.lit(fallback)))


#: Prefixes that a variant's short tag drops, the first that fits of the last group.
OUTER, GROUP = ("trainer_", "enrollment_"), ("processed-", "raw-", "hybrid-", "lasalle-", "lfw-")


def compact_tag(variant: Column) -> Column:
    """A variant's name as a short tag of lower-case letters, digits and hyphens."""
    v = F.lower(F.trim(variant))
    v = F.when(F.startswith(v, F.lit("trainer_")) & F.contains(v, F.lit("_labels_")), F.substring_index(v, "_labels_", 1)).otherwise(v)
    for p in OUTER:
        v = F.regexp_replace(v, f"^{p}", "")
    v = F.regexp_replace(F.regexp_replace(v, "^(" + "|".join(GROUP) + ")", ""), "^[_-]+|[_-]+$", "")
    short = F.regexp_replace(F.regexp_replace(v, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(v == "processed", "p").when(v == "raw", "r").when(short != "", short).otherwise("default")


def aug_list(splits: Column) -> Column:
    """Names between commas, trimmed, lower-cased, each once and in order; blanks go."""
    return F.array_sort(F.array_distinct(csv_list(splits)))


def dataset_label(raw: Column, processed: Column, augmented: Column, splits: Column, split: Column) -> Column:
    """raw=.. | processed=.. | aug=..[..] | split=..; parts that are null are left out."""
    names = F.array_join(aug_list(F.coalesce(splits, F.lit(""))), ",")
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + "="), c))
    aug = F.when(augmented.isNotNull(), F.concat(F.lit("aug="), augmented, F.lit("["), F.when(names != "", names).otherwise("all"), F.lit("]")))
    label = F.concat_ws(" | ", part("raw", raw), part("processed", processed), aug, part("split", F.nullif(split, F.lit(""))))
    return F.when(label != "", label).otherwise("no_dataset_selected")


#: The word for a part that is switched off, and what the names of folders hold that have a family of their own.
DISABLED, CLEAN_FOLDER, RAW_FOLDER, PROCESSED_FOLDER = "__disabled__", "split_lasalle", "lasalle", "lfw"


def combo_slug(raw: Column, processed: Column, splits: Column, base: Column, with_raw: Column, with_processed: Column, with_augmented: Column) -> Column:
    """Short name of a combination of data sets: a family and letters for the parts that the family doesn't tell."""
    folder = lambda c: F.lower(F.regexp_extract(c, "([^/]*)/*$", 1))
    slashes = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    has = lambda c, x: F.contains(c, F.lit(x))
    with_raw = with_raw & (raw != DISABLED)
    with_augmented = with_augmented & (F.trim(splits) != DISABLED)
    clean = has(slashes(base), CLEAN_FOLDER) | has(slashes(raw), CLEAN_FOLDER)
    family = (
        F.when(clean, "lasalleclean")
        .when(with_raw & has(folder(raw), RAW_FOLDER), "lasalle")
        .when(with_processed & has(folder(processed), PROCESSED_FOLDER), "lfw")
        .when(with_raw & with_processed, "hybrid")
        .when(with_raw, "raw")
        .when(with_processed, "processed")
        .otherwise("dataset")
    )
    names = csv_list(splits)
    letter = lambda c, x: F.when(c, x).otherwise("")
    letters = F.concat(
        letter(with_raw & ~family.isin("lasalle", "lasalleclean", "hybrid"), "r"),
        letter(with_processed & ~family.isin("lfw", "hybrid"), "p"),
        letter(with_augmented & F.array_contains(names, "light"), "l"),
        letter(with_augmented & F.array_contains(names, "medium"), "m"),
    )
    return F.when(letters == "", family).otherwise(F.concat(family, F.lit("-"), letters))


def confidence(d: Column, t: Column) -> Column:
    """100 * (1 - d / max(1, t)), held to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - d / F.greatest(F.lit(1.0), t))))


def csv_list(c: Column) -> Column:
    """Items between commas, trimmed and lower-cased, blank ones left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
