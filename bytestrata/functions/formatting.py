"""Scalar column expressions of the catalog: names, sizes, numbers, modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def grouped(n: Column) -> Column:
    """Digits in groups of three, parted by spaces."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def size_column(n: Column) -> Column:
    """Right-aligned number and unit; the unit grows once the size is above nine of the next, and the number is rounded half up."""
    out = F.format_string("%6d %-2s", n, F.lit(UNITS[0]))
    for k, unit in enumerate(UNITS[1:], 1):
        size = 1024**k
        out = F.when(n > 9 * size, F.format_string("%6d %-2s", F.floor((n + size // 2) / F.lit(size)).cast("long"), F.lit(unit))).otherwise(out)
    return out


def short_name(name: Column) -> Column:
    """Names of over 40 characters: dots and the last 37."""
    return F.when(F.length(name) > 40, F.concat(F.lit("..."), F.right(name, F.lit(37)))).otherwise(name)


def extension(path: Column) -> Column:
    """What follows the last dot of the last component, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stored_name(path: Column) -> Column:
    """Without a drive, and without leading '/', './' and '../'."""
    return F.regexp_replace(path, r"^([A-Za-z]:)?(/|\./|\.\./)*", "")


def archive_name(name: Column, suffix: str = ".arc") -> Column:
    return F.when(F.endswith(name, F.lit(suffix)) | F.endswith(name, F.lit(".exe")), name).otherwise(F.concat(name, F.lit(suffix)))


def escapes_target(path: Column) -> Column:
    """Whether a stored path leaves the folder it is written under: absolute, with a drive, or with more '..' than components before them."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, x: F.struct(
            (a["now"] + F.when(x == "..", -1).otherwise(1)).alias("now"),
            F.least(a["low"], a["now"] + F.when(x == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda a: a["low"],
    )
    return path.rlike(r"^([A-Za-z]:|/|\\)") | (depth < 0)


def parse_size(text: Column) -> Column:
    """'<n>[k,m,g]' with an optional decimal part, in bytes, rounded down; null for anything else; empty is 0."""
    good = text.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)[kmg]?$")
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("decimal(20,6)")
    unit = F.when(F.endswith(text, F.lit("k")), 1024).when(F.endswith(text, F.lit("m")), 1048576).when(F.endswith(text, F.lit("g")), 1073741824).otherwise(1)
    return F.when(text == "", F.lit(0).cast("long")).when(good, F.floor(number * unit.cast("decimal(12,0)")).cast("long"))


def duration(ms: Column) -> Column:
    """Seconds with two decimals; hours and minutes where they are not zero."""
    hours, minutes = F.floor(ms / 3600000), F.floor(ms / 60000) % 60
    seconds = F.format_string("%d.%02ds", F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100)
    return F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "))).otherwise(""), seconds)


def progress(done: Column, total: Column) -> Column:
    """Percent, of KB with the lowest bit set so that nothing is divided by zero."""
    return F.floor(F.shiftright(done, 10).bitwiseOR(F.lit(1)) * 100 / F.shiftright(total, 10).bitwiseOR(F.lit(1))).cast("long")


def byte_float(p: Column) -> Column:
    """A size in one byte: mantissa of 4 bits, exponent of 4, in units of 64 KB."""
    x = p + 1
    m, s = x.bitwiseAND(F.lit(15)), F.shiftright(x, 4)
    return F.when(s > 0, (m + 16) * F.pow(F.lit(2), s - 1)).otherwise(m).cast("long") * 65536


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 4, "0")


def attribute_letters(nibble: Column) -> Column:
    """Archive, read-only, hidden and system flags."""
    return F.concat(*(F.when(nibble.bitwiseAND(F.lit(bit)) != 0, c).otherwise("-") for bit, c in ((8, "A"), (1, "R"), (2, "H"), (4, "S"))))


def ipv4(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def case_mode(word: Column) -> Column:
    """0: as in lower case, 1: first letter upper, 2: all upper, 3: anything else."""
    low, up = F.lower(word), F.upper(word)
    return F.when(word == low, 0).when(word == F.concat(F.upper(F.left(word, F.lit(1))), F.substring(low, 2, 1 << 30)), 1).when(word == up, 2).otherwise(3)


def glob_regex(glob: str) -> str:
    """A regular expression for a whole-name glob with *, ? and [...]."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out += "[" + "^" * (body[0] == "!") + "".join("\\" + x if x in r"\[]&^" else x for x in body[body[0] == "!" :]) + "]"
            k = end
        else:
            out += "\\" + c if c in r"\.+(){}^$|[]" else c
        k += 1
    return f"^(?s:{out})$"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether any of the globs fits; false without globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out
