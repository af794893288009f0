"""Text codes as native expressions: member keys, packed codes, test names, durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix a base case name must carry, and the width of member numbers.
BASE_SUFFIX = ".0000"
MEMBER_WIDTH = 4

# Stop option -> kind of consistency test.
TEST_TYPES = {"nmonths": "ECT", "nyears": "POP-ECT"}
OTHER_TEST_TYPE = "UF-ECT"

# Defaults of a run that gives no settings of its own.
OCEAN_DEFAULTS = {"compset": "G", "res": "T62_g17"}
ATMOSPHERE_DEFAULTS = {"compset": "F2000climo", "res": "f19_f19"}
WALLTIME_UNSET = "00:00"
WALLTIME_SHORT = "00:10"
WALLTIME_OCEAN = "02:00"
WALLTIME_ATMOSPHERE = "04:30"

# Release stages from early to late.
STAGES = ["alpha", "beta", "rel", ""]


def member_key(case: Column, member: Column) -> Column:
    """Name of a member's case; null when the base name does not end in ``.0000``."""
    stem = F.substring(case, F.lit(1), F.length(case) - len(BASE_SUFFIX))
    number = member.cast("string")
    padded = F.when(F.length(number) < MEMBER_WIDTH, F.lpad(number, MEMBER_WIDTH, "0")).otherwise(number)
    return F.when(case.endswith(BASE_SUFFIX), F.concat(stem, F.lit("."), padded))


def classify_testtype(stop_option: Column) -> Column:
    out = F.lit(OTHER_TEST_TYPE)
    for option, kind in TEST_TYPES.items():
        out = F.when(stop_option == option, kind).otherwise(out)
    return out


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit("NONE"))


def default_compset(compset: Column, ect: Column) -> Column:
    fallback = F.when(ect == "pop", OCEAN_DEFAULTS["compset"]).otherwise(ATMOSPHERE_DEFAULTS["compset"])
    return F.coalesce(_given(compset), fallback)


def default_res(res: Column, ect: Column) -> Column:
    fallback = F.when(ect == "pop", OCEAN_DEFAULTS["res"]).otherwise(ATMOSPHERE_DEFAULTS["res"])
    return F.coalesce(_given(res), fallback)


def default_walltime(walltime: Column, ect: Column, short_run: Column) -> Column:
    fallback = (
        F.when(short_run, WALLTIME_SHORT)
        .when(ect == "pop", WALLTIME_OCEAN)
        .otherwise(WALLTIME_ATMOSPHERE)
    )
    return F.coalesce(F.nullif(walltime, F.lit(WALLTIME_UNSET)), fallback)


def parse_duration(raw: Column) -> Column:
    """Seconds of ``hh:mm:ss`` or ``hh:mm`` with blanks around; null when malformed."""
    text = F.trim(raw)
    shape = r"^(\d+):([0-5]?\d)(?::([0-5]?\d))?$"
    hours, minutes, seconds = (F.regexp_extract(text, shape, i).try_cast("bigint") for i in (1, 2, 3))
    total = hours * 3600 + minutes * 60 + F.coalesce(seconds, F.lit(0))
    return F.when(text.rlike(shape), total)


def code_parts(code: Column) -> Column:
    """``A%x%y_B_C%z`` -> array of (pos, model, phys array)."""
    words = F.transform(F.split(code, "_"), lambda token: F.split(token, "%"))
    return F.transform(
        words,
        lambda w, pos: F.struct(
            pos.alias("pos"), F.element_at(w, 1).alias("model"), F.slice(w, F.lit(2), F.size(w)).alias("phys")
        ),
    )


def parse_code(code: Column, names: Sequence[str]) -> Column:
    """Packed code -> struct(time, comps, tail); component i gets ``names[i]``.

    Tokens after the named positions are the optional tail (a named option such
    as ``BGC%x`` or a bare ``TEST``).
    """
    parts = code_parts(code)
    labels = F.array(*[F.lit(n) for n in names])
    comps = F.transform(
        F.slice(parts, 2, len(names)),
        lambda p: F.struct(
            F.try_element_at(labels, p["pos"]).alias("name"), p["model"].alias("model"), p["phys"].alias("phys")
        ),
    )
    tail = F.filter(parts, lambda p: p["pos"] > len(names))
    return F.struct(F.element_at(parts, 1)["model"].alias("time"), comps.alias("comps"), tail.alias("tail"))


def make_key(name: Column, grid: Column, compset: Column, machine: Column, compiler: Column, mods: Column) -> Column:
    """``name.grid.compset.machine_compiler[.mods]`` with ``/`` in mods as ``-``."""
    return F.concat_ws(
        ".", name, grid, compset, F.concat_ws("_", machine, compiler), F.replace(mods, F.lit("/"), F.lit("-"))
    )


def parse_key(key: Column) -> Column:
    parts = F.split(key, r"\.")
    platform = F.try_element_at(parts, F.lit(4))
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("name"),
        F.try_element_at(parts, F.lit(2)).alias("grid"),
        F.try_element_at(parts, F.lit(3)).alias("compset"),
        F.regexp_extract(platform, r"^(.*)_([^_]*)$", 1).alias("machine"),
        F.regexp_extract(platform, r"^(.*)_([^_]*)$", 2).alias("compiler"),
        F.try_element_at(parts, F.lit(5)).alias("mods"),
    )


def parse_modifiers(name: Column) -> Column:
    """Test name -> base, run length, debug, layout, mpi library, instances, rest."""
    tokens = F.split(name, "_")
    mods = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))

    def one(pattern: str, group: int) -> Column:
        hit = F.try_element_at(F.filter(mods, lambda t: t.rlike(pattern)), F.lit(1))
        return F.regexp_extract(hit, pattern, group)

    length, layout, mpi, multi = r"^L([a-z])(\d+)$", r"^P(\d+)x(\d+)$", r"^M([a-z].*)$", r"^C(\d+)$"
    known = f"{length}|{layout}|{mpi}|{multi}|^D$|^PM$"
    return F.struct(
        F.element_at(tokens, 1).alias("base"),
        one(length, 1).alias("length_unit"),
        one(length, 2).try_cast("int").alias("length_n"),
        F.array_contains(mods, "D").alias("debug"),
        one(layout, 1).try_cast("int").alias("ntasks"),
        one(layout, 2).try_cast("int").alias("nthrds"),
        one(mpi, 1).alias("mpilib"),
        F.array_contains(mods, "PM").alias("mixed_threads"),
        one(multi, 1).try_cast("int").alias("instances"),
        F.array_join(F.filter(mods, lambda t: ~t.rlike(known)), "_").alias("rest"),
    )


def version_parts(tag: Column) -> Column:
    """``X.Y.Z``, ``release-name2.1`` or ``name3_0_beta07`` -> struct(line, major, minor, patch, stage, stage_no).

    Numbers have up to 18 digits; anything else is an unknown shape, and null.
    """
    shape = r"^((?:release-)?[A-Za-z]*)(\d{1,18})[._](\d{1,18})(?:[._](\d{1,18}))?(?:[._]?(alpha|beta|rel)(\d{0,18}))?$"

    def group(i: int) -> Column:
        return F.regexp_extract(tag, shape, i)

    stage = group(5)
    return F.when(
        tag.rlike(shape),
        F.struct(
            group(1).alias("line"),
            group(2).try_cast("bigint").alias("major"),
            group(3).try_cast("bigint").alias("minor"),
            F.coalesce(group(4).try_cast("bigint"), F.lit(0).cast("bigint")).alias("patch"),
            (F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1).cast("int").alias("stage"),
            F.coalesce(group(6).try_cast("bigint"), F.lit(0).cast("bigint")).alias("stage_no"),
        ),
    )


def version_key(parts: Column) -> Column:
    """Text that orders :func:`version_parts` by meaning; null for unknown shapes."""
    return F.concat(*(F.lpad(parts[name].cast("string"), 18, "0") for name in ("major", "minor", "patch", "stage", "stage_no")))


def extract_cost(note: Column) -> Column:
    """``12.5 ypd and 640 pe-hrs`` -> struct(ypd, pe_hours)."""
    number = r"(\d+(?:\.\d+)?)"
    return F.struct(
        F.regexp_extract(note, number + r"\s*ypd", 1).try_cast("double").alias("ypd"),
        F.regexp_extract(note, number + r"\s*pe-hrs", 1).try_cast("double").alias("pe_hours"),
    )
