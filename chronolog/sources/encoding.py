"""One encoding per file, decided from all of the file's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolog.sources.lookup import lookup_by_file, materialized

PROFILES = ("utf8_first", "cp1251_first", "lossy")
UNASSIGNED = b"\x98"  # the one byte windows-1251 does not define
REPLACEMENT = "�"


def _bytes(line: Column) -> Column:
    return line.cast("binary")


def is_ascii(line: Column) -> Column:
    return F.octet_length(line) == F.length(line)


#: Letters of Russian text by how often they occur. Fixed values.
FREQUENT, RARE = "оеаинтсрвлкмдпу", "яыьгзбчйхжшюцщэфъё"
#: Classes of characters above ASCII, and a capital behind a small letter: log likelihood of Russian text in
#: the right charset against bytes of another one.
CLASSES = "\u0001\u0002\u0003\u0004\u0005"  # frequent small, rare small, frequent capital, rare capital, anything else
LIKELIHOOD = (1.4, -0.2, -2.3, -3.2, -4.2)
CAPITAL_INSIDE = -3.0
DETECTED = {"cp1251": "windows-1251", "koi8_r": "KOI8-R", "cp866": "IBM866"}
#: The detector speaks for a charset from this probability on, and from so many characters above ASCII.
CONFIDENCE, EVIDENCE = 0.7, 8


def _likelihood(line: Column, charset: str) -> Column:
    """How much a line looks like Russian text in a charset, and its characters above ASCII."""
    letters = FREQUENT + RARE + FREQUENT.upper() + RARE.upper()
    sizes = [len(FREQUENT), len(RARE)] * 2
    signs = "".join(c * n for c, n in zip(CLASSES, sizes))
    classes = F.regexp_replace(F.translate(F.decode(_bytes(line), charset), letters, signs), "[^\\x00-\\x7F]", CLASSES[4])
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    inside = F.regexp_count(classes, F.lit(f"[{CLASSES[0]}{CLASSES[1]}](?=[{CLASSES[2]}{CLASSES[3]}])"))
    return sum((count(classes, c) * F.lit(w) for c, w in zip(CLASSES, LIKELIHOOD)), inside * F.lit(CAPITAL_INSIDE))


def file_encodings(raw: DataFrame, profile: str = "utf8_first") -> DataFrame:
    """Files not to be read as UTF-8, and how to read them.

    A file whose first line begins with a UTF-16 byte order mark is UTF-16. Else a file is UTF-8 when all its lines are.
    Else the charset counts that makes its lines most likely Russian text (``DETECTED``), if that is more probable than
    ``CONFIDENCE``; else it is windows-1251 (``cp1251``). Where the byte that windows-1251 does not define occurs, the
    profile's last resort follows, with replacement characters: the bytes as UTF-8, or, for ``cp1251_first``, as
    windows-1251. One map-side combined aggregation with at most one row per file; beyond validity only
    lines that are no UTF-8 are looked at.
    """
    line, uri = F.col("line"), ["uri"] if "uri" in raw.columns else []
    odd = ~F.is_valid_utf8(line)
    start = F.when(F.col("file_block_start") == 0, F.struct("line_seq", F.hex(F.substring(_bytes(line), 1, 2)).alias("mark")))
    high = F.when(odd, F.octet_length(line) - F.length(F.regexp_replace(F.decode(_bytes(line), "ISO-8859-1"), "[^\\x00-\\x7F]", "")))
    per_file = raw.groupBy("file_path").agg(
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"),
        F.bool_or(F.contains(_bytes(line), F.lit(UNASSIGNED))).alias("unassigned"),
        F.min(start)["mark"].alias("mark"),
        F.sum(high).alias("high"),
        *[F.sum(F.when(odd, _likelihood(line, charset))).alias(name) for name, charset in DETECTED.items()],
        *[F.min(c).alias(c) for c in uri],
    )
    best = F.greatest(*DETECTED)
    others = sum((F.exp(F.col(name) - best) for name in DETECTED), F.lit(0.0))
    sure = (F.col("high") >= EVIDENCE) & (best > 0) & (1 / others > CONFIDENCE)
    last_resort = "cp1251_replace" if profile == "cp1251_first" else "replace"
    encoding = (
        F.when(F.col("mark") == "FFFE", "utf_16_le")
        .when(F.col("mark") == "FEFF", "utf_16_be")
        .when(sure & (F.col("koi8_r") == best), "koi8_r")
        .when(sure & (F.col("cp866") == best), "cp866")
        .when(F.col("unassigned"), last_resort)
        .otherwise("cp1251")
    )
    return per_file.where(~F.col("utf8")).select("file_path", encoding.alias("encoding"), *uri)


def wide_lines(raw: DataFrame, little: bool) -> DataFrame:
    """Lines of UTF-16 files from pieces cut at the bytes of a line feed.

    Those bytes also stand across two characters. Such a false cut leaves a piece of an odd number of bytes, and so does
    the next true one after it: what lies from one odd piece to the next is one line. Odd pieces are few, so
    only their places are sorted by file. The byte order mark and a carriage return at the end go; what is no UTF-16
    becomes replacement characters.
    """
    raw = raw.withColumn("bytes", _bytes(F.col("line"))).withColumn("place", F.struct("file_block_start", "line_seq"))
    odd = materialized(raw.where(F.octet_length("bytes") % 2 == 1).select("file_path", "place"))
    if odd.head(1):
        by_file = Window.partitionBy("file_path").orderBy("place")
        numbered = odd.withColumn("number", F.row_number().over(by_file)).withColumn("until", F.lead("place").over(by_file))
        runs = materialized(numbered.where("number % 2 = 1").select(F.col("file_path").alias("of"), F.col("place").alias("from"), "until"))
        inside = (F.col("of") == F.col("file_path")) & (F.col("place") >= F.col("from")) & (F.col("place") <= F.coalesce("until", "from"))
        marked = raw.join(runs, inside, "left")
        parts = F.sort_array(F.collect_list(F.struct("place", "bytes")))
        feed = F.unhex(F.lit("0A00" if little else "000A"))
        glued = F.aggregate(
            F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0))["bytes"], lambda done, part: F.concat(done, feed, part["bytes"])
        )
        joined = marked.where("of IS NOT NULL").groupBy("file_path", "from").agg(glued.alias("bytes"))
        whole = marked.where("of IS NULL").select("bytes", "file_path", "file_block_start", "line_seq")
        raw = whole.unionByName(joined.select("bytes", "file_path", "from.file_block_start", "from.line_seq"))
    text = F.decode(F.col("bytes"), "UTF-16LE" if little else "UTF-16BE")
    line = F.regexp_replace(text, "^\ufeff|\r$", "")
    return raw.select(line.alias("line"), "file_path", "file_block_start", "line_seq")


def decode_lines(raw: DataFrame, profile: str = "utf8_first", encodings: DataFrame | None = None) -> DataFrame:
    """Decode each file's lines by one encoding.

    Pure ASCII lines read the same in every encoding, so they take no part in the lookup. ``encodings`` is what
    ``file_encodings`` gave, where that is known already. UTF-16 needs another reader: see ``wide_lines``.
    """
    if profile not in PROFILES:
        raise ValueError(f"encoding profile must be one of {PROFILES}")
    line = F.col("line")
    if profile == "lossy":
        return raw.withColumn("line", F.replace(F.make_valid_utf8(line), F.lit(REPLACEMENT), F.lit("")))
    marked = raw.withColumn("_file", F.when(~is_ascii(line) | ~F.is_valid_utf8(line), F.col("file_path")))
    known = lookup_by_file(marked, file_encodings(raw, profile) if encodings is None else encodings, "_file", "file_path")
    cp1251 = F.decode(_bytes(line), "windows-1251")
    decoded = (
        F.when(F.col("encoding") == "cp1251", cp1251)
        .when(F.col("encoding") == "koi8_r", F.decode(_bytes(line), DETECTED["koi8_r"]))
        .when(F.col("encoding") == "cp866", F.decode(_bytes(line), DETECTED["cp866"]))
        .when(F.col("encoding") == "replace", F.make_valid_utf8(line))
        .when(F.col("encoding") == "cp1251_replace", _cp1251_replacing(line))
        .otherwise(line)
    )
    return known.withColumn("line", decoded).drop("_file", "encoding")


def _cp1251_replacing(line: Column) -> Column:
    """Decode around the undefined byte, which becomes a replacement character."""
    pairs = F.regexp_replace(F.hex(_bytes(line)), "(..)", "$1_")
    pieces = F.split(pairs, UNASSIGNED.hex() + "_")
    texts = F.transform(
        pieces, lambda piece: F.decode(F.unhex(F.replace(piece, F.lit("_"), F.lit(""))), "windows-1251")
    )
    return F.array_join(texts, REPLACEMENT)
