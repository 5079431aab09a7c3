"""Problem 2: files that are not hand-written source of their repository.

Layout statistics of the whole text, thresholded per language: line lengths, white space, letters and digits,
numbers, encoded runs and repeated lines. Copies of other projects are laid out like hand-written source, and short
output may be too; these are told by the notices in their comments and by their folders, and the result says
which of the two spoke. Everything is a Catalyst expression, so no text leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines at the top of a file in which a notice needs no comment sign; further down it needs one.
HEAD_LINES = 15
#: Least lines for a repeated line shape to tell anything.
SHAPE_LINES = 8

# Phrases by which tools mark their output, in a comment.
GENERATED = (
    r"auto-?\s?generated", r"automatically (?:generated|created|produced)", r"(?:code|file|source|output) (?:was |is )?(?:generated|produced|emitted) by", r"@generated\b",
    r"generated (?:on|at) \d{4}-", r"generated (?:by|from|with) \S+\.(?:schema|proto|grammar|idl|y|l)\b", r"do not (?:edit|modify)", r"produced from \S+\.\w+", r"source: \S+\s+compiler:", r"machine[ -](?:written|made|generated)", r"run `?make \S+ to (?:refresh|regenerate|update)", r"changes (?:are|will be) lost",
    r"(?:fichier|code) (?:produit|généré|genere) par", r"(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)", r"generado (?:automáticamente|automaticamente|por)", r"ne pas modifier", r"nicht bearbeiten",
    r"no (?:editar|modificar)", r"не редактировать|создан автоматически",
)
# Phrases by which copies name their origin, in a comment.
COPIED = (
    r"vendored (?:from|copy)", r"(?:imported|verbatim|bundled|vendored|unmodified|local) copy of", r"copied (?:verbatim )?from (?:https?://|\S+ v?\d)", r"(?:taken|imported|mirrored) from https?://",
    r"upstream (?:release|version|commit)", r"\(c\) (?:19|20)\d\d the \S+ authors", r"copyright (?:\(c\) )?(?:(?:19|20)\d\d )?the \S+ (?:contributors|authors)",
)
# Folders that hold other projects' packages, each below one of them.
PACKAGE_FOLDERS = "_vendor|vendor|third[_-]?party|node_modules|site-packages|bower_components|bundled|deps|ext|external|contrib/upstream|Godeps|Pods|jspm_packages"

# Fixed values per language: a file is output or data where its statistic passes the bound.
#: share of lines of the commonest shape, number share, share of numbered identifiers, mean line length, share of
#: letters, digits and underscores, white space (a lower bound, in files with a line above LONG_LINE), share of encoded runs.
BOUNDS = {
    "py": (0.75, 0.50, 0.14, 160.0, 0.86, 0.10, 0.45),
    "js": (0.75, 0.50, 0.14, 120.0, 0.86, 0.10, 0.45),
    "java": (0.37, 0.40, 0.16, 160.0, 0.86, 0.10, 0.45),
    "c": (0.42, 0.50, 0.14, 160.0, 0.86, 0.10, 0.45),
    "sh": (0.60, 0.50, 0.18, 160.0, 0.86, 0.06, 0.50),
    "toml": (0.60, 0.75, 0.40, 200.0, 0.90, 0.04, 0.60),
    "yaml": (0.85, 0.75, 0.40, 200.0, 0.92, 0.04, 0.60),
    "json": (0.85, 0.75, 0.40, 2000.0, 0.86, 0.02, 0.60),
}
#: Characters of a line that hand-written code seldom has; least characters of a file whose shares tell anything.
LONG_LINE, SOME_TEXT = 500, 500

# Every phrase above holds one of these, by which most heads are passed over.
_GENERATED_STEMS = ("generat", "created", "produ", "emitted", "edit", "modif", "erzeugt", "erstellt", "genere", "généré", "generado", "nicht", "создан", "редакт", "written", "made", "refresh", "update", "lost", "compiler:")
_COPIED_STEMS = ("vendored", "copy of", "copied", "taken", "imported", "mirrored", "upstream", "authors", "contributors")

_COMMENT = r"(?im)^[ \t]*(?:#|//|/\*+!?|\*|--|;|<!--|\"\"\"|''')?[^\n\"'`=]{0,80}?(?:%s)"


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def language(path: Column) -> Column:
    """The language of a path's extension, in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit("")))


def _noticed(head: Column, stems: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    low = F.lower(head)
    some = F.lit(False)
    for stem in stems:
        some = some | low.contains(stem)
    return F.when(some, head.rlike(_COMMENT % "|".join(phrases))).otherwise(False)


def _bound(lang: Column, i: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in BOUNDS.items():
        out = F.when(lang == name, F.lit(values[i])).otherwise(out)
    return out


def layout(df: DataFrame, item: str, path: str, text: str) -> DataFrame:
    """(item, path, lang, layout statistics) of each row with a text; null and empty texts are left out."""
    t = F.col("_t")
    base = df.where(F.length(text) > 0).select(F.col(item).alias(item), clean_path(F.col(path)).alias("path"), F.regexp_replace(F.col(text), r"\r\n?", "\n").alias("_t"))
    # A line's shape: strings, names and numbers reduced to one sign each.
    # Possessive groups: a repeated alternation would recurse once per character and exhaust the task's stack.
    shaped = F.regexp_replace(t, r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", "S")
    shaped = F.regexp_replace(shaped, r"[\p{L}_$][\p{L}\p{N}_$]*+[ \t]*+", "w")
    shaped = F.regexp_replace(shaped, r"[0-9][\p{L}\p{N}_.]*+[ \t]*+|[ \t]++", "9")
    no_keys = F.when(t.contains("-----BEGIN"), F.regexp_replace(t, r"-----BEGIN [^-]*+-----[^-]*+-----END [^-]*+-----", "")).otherwise(t)
    # Comment lines of the whole text, without their signs.
    comments = F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*+(?:#|//|/\*++!?|\*|--|;|<!--)([^\n]*+)"), F.lit(1))
    # Each pass over the text is made once, in this projection; what follows reads its columns.
    passes = base.select(
        item,
        "path",
        "_t",
        language(F.col("path")).alias("lang"),
        F.length(t).cast("double").alias("size"),
        F.transform(F.split(t, "\n"), lambda line: F.length(line)).alias("_lengths"),
        F.array_sort(F.filter(F.split(shaped, "\n"), lambda s: F.length(s) > 1)).alias("_shapes"),
        no_keys.alias("_no_keys"),
        comments.alias("_comments"),
        F.regexp_replace(t, r"\w++", "\x01").alias("_signs"),  # each word one sign: tells their number and their length
    )
    # The longest run in the sorted shapes is the commonest shape.
    start = F.struct(F.lit("").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, s: Column) -> Column:
        run = F.when(acc["at"] == s, acc["run"] + 1).otherwise(1)
        return F.struct(s.alias("at"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    size, lengths = F.col("size"), F.col("_lengths")
    others = F.length(F.replace("_signs", F.lit("\x01"), F.lit("")))
    words = F.greatest(F.length("_signs") - others, F.lit(1))
    encoded = F.aggregate(F.regexp_extract_all("_no_keys", F.lit(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{44,}+={0,2}"), F.lit(0)), F.lit(0), lambda a, r: a + F.length(r))
    pins = F.when(t.contains("resolved") | t.contains("integrity") | t.contains("checksum"), F.regexp_count(t, F.lit(r"(?m)^\s*[\"']?(?:resolved|integrity|checksum)[\"']?\s*[:=]"))).otherwise(0)
    stats = passes.select(
        item,
        "path",
        "lang",
        F.array_join(F.concat(F.slice(F.split(t, "\n"), 1, HEAD_LINES), "_comments"), "\n").alias("head"),
        F.array_max(lengths).alias("max_line"),
        (size / F.size(lengths)).alias("mean_line"),
        (1 - (F.length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))) - F.size(lengths) + 1) / size).alias("space"),
        (1 - others / size).alias("alnum"),
        (F.regexp_count(t, F.lit(r"\b(?<!\.)(?:0x[0-9A-Fa-f]++|\d++(?:\.\d++)?+)(?!\w)")) / words).alias("numbers"),
        (F.regexp_count("_no_keys", F.lit(r"\b[A-Za-z_$]{1,24}+\d{1,6}+(?:_[A-Za-z]\w{0,30}+)?+\b")) / words).alias("numbered_names"),
        F.when(t.contains("/***/"), F.regexp_count(t, F.lit(r"(?m)^/\*{3}/"))).otherwise(0).alias("module_marks"),
        (encoded / size).alias("encoded"),
        (pins / F.size(lengths)).alias("pins"),
        pins.alias("n_pins"),
        "size",
        F.size(lengths).alias("lines"),
        F.aggregate("_shapes", start, step, lambda acc: acc["most"]).alias("same_shape"),
        F.size("_shapes").alias("shapes"),
    )
    # One struct in one Generate: later filters on the statistics cannot be pushed below it and repeat the work.
    names = [c for c in stats.columns if c not in (item, "path")]
    return stats.select(item, "path", F.inline(F.array(F.struct(*names))))


def not_handwritten(df: DataFrame, item: str, path: str, text: str) -> DataFrame:
    """(item, path, lang, kind, layout, notice, statistics): files that were produced, minified, copied or hold data.

    ``layout`` is what the statistics say alone (minified, data or generated), ``notice`` what comments and folders
    say (third_party or generated), null where they say nothing; ``kind`` is the notice's third_party, else its
    generated, else the layout's. Files of other languages are judged by notices and places only. Null and
    empty texts are never cases; a null path has no language and no place. Repeated files under other ids are
    judged alike.
    """
    m = layout(df, item, path, text)
    head, lang = F.col("head"), F.col("lang")
    some = F.col("size") > SOME_TEXT
    shape_share = F.when(F.col("shapes") >= SHAPE_LINES, F.col("same_shape") / F.col("shapes")).otherwise(0.0)
    copied = _noticed(head, _COPIED_STEMS, COPIED)
    placed = F.col("path").rlike(rf"(?:^|/)(?:{PACKAGE_FOLDERS})/[^/]+/")
    marked = _noticed(head, _GENERATED_STEMS, GENERATED)
    repeated = (shape_share >= _bound(lang, 0)) | (F.col("numbered_names") >= _bound(lang, 2)) & (F.col("size") > 400) | (F.col("module_marks") >= 4) | (F.col("n_pins") >= 3) & (F.col("pins") > 0.12)
    minified = (F.col("mean_line") >= _bound(lang, 3)) | (F.col("space") < _bound(lang, 5)) & (F.col("max_line") > LONG_LINE)
    data = ((F.col("numbers") >= _bound(lang, 1)) | (F.col("alnum") >= _bound(lang, 4)) | (F.col("encoded") >= _bound(lang, 6))) & some
    by_layout = F.when(minified, "minified").when(data, "data").when(repeated, "generated")
    by_notice = F.when(F.coalesce(copied | placed, copied), "third_party").when(marked, "generated")
    out = m.withColumn("layout", by_layout).withColumn("notice", by_notice).withColumn("kind", F.coalesce("notice", "layout"))
    return out.withColumn("shape_share", shape_share).where(F.col("kind").isNotNull()).drop("head", "same_shape", "shapes", "n_pins")
