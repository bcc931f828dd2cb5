"""Scalar functions of the collection model, as column expressions."""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

#: Keys that name an object or a link in catalog rows, first match wins; image extensions; junk files and folders.
OBJECT_KEYS = ["object_id", "record_id", "item_id", "group_id"]
LINK_KEYS = ["source_url", "guid", "record_url", "landing_page", "permalink"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif", "avif"]
JUNK_NAMES = [".ds_store", "thumbs.db", "desktop.ini", ".picasa.ini"]
JUNK_FOLDERS = [".git", "__pycache__", ".cache", "node_modules", ".thumbnails"]
#: Years, identifiers and placeholders in names of files and folders.
YEAR = r"(1[6-9]\d{2}|20[0-4]\d)"
CAMERA = r"(?i)^(DSC|IMG|DSCN|PICT|CIMG)"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
IDENTIFIER = r"(?i)^[a-z]+[_-]?\d{4,}$"
PLACEHOLDER = r"(?i)^(new folder|untitled|copy of|temp|tmp)"


# --- vectors -----------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Left-folded in doubles, so that sums are the same everywhere."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def literal_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def scaled_score(s: Column, scale: float) -> Column:
    return s * F.lit(scale)


def sigmoid_score(s: Column, scale: float, bias: float) -> Column:
    return 1 / (1 + F.exp(-(s * F.lit(scale) + F.lit(bias))))


# --- ids, paths and links ----------------------------------------------------


def item_id(key: Column) -> Column:
    """Url-safe base64 of the key, without padding and line ends."""
    flat = F.regexp_replace(F.base64(F.encode(key, "UTF-8")), r"[\r\n=]", "")
    return F.translate(flat, "+/", "-_")


def shard_path(root: str, key: Column) -> Column:
    digest = F.sha1(key)
    return F.concat(F.lit(root + "/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".jpg"))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def first_link(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c.startswith("http://") | c.startswith("https://"), c) for c in columns))


def url_key(url: Column) -> Column:
    """Decoded path of a URL without its leading slash (a plus stays one, and so does a percent sign without two digits); what is no URL stays as it is."""
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*/*([^?#]*)", 1)
    plain = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(url.contains("://"), F.url_decode(plain)).otherwise(url)


def basename(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def extension(key: Column) -> Column:
    """After the last dot of the base name, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(basename(key), r"\.([^.]*)$", 1))


def is_junk(key: Column) -> Column:
    return F.lower(basename(key)).isin(JUNK_NAMES) | basename(key).startswith("._")


def is_image(key: Column) -> Column:
    return extension(key).isin(IMAGE_EXTENSIONS)


def stored_path(path: Column, data_folder: str | None) -> Column:
    """A path below the data folder without it; others, and all without such a folder, as they are."""
    if not data_folder:
        return path
    root = data_folder.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def resolved_path(path: Column, data_folder: str | None) -> Column:
    """The opposite: relative paths stand below the data folder."""
    if not data_folder:
        return path
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(data_folder.rstrip("/") + "/"), path))


def url_quoted(text: Column) -> Column:
    """Percent-encoded, spaces and slashes included."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def url_segment(url: Column, n: int) -> Column:
    """The n-th part between slashes, from 0; null where there is none."""
    return F.get(F.split(url, "/"), F.lit(n))


def client_address(forwarded: Column, hops: int, peer: Column) -> Column:
    """The n-th address from the right of a forwarded list; the peer's where it is shorter, or where no proxies are declared."""
    if not hops:
        return peer
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= hops, F.try_element_at(parts, F.lit(-hops))).otherwise(peer)


# --- text --------------------------------------------------------------------


def words(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def shape(identifier: Column) -> Column:
    """Digits as 9, letters as A."""
    return F.regexp_replace(F.regexp_replace(identifier, r"\p{Nd}", "9"), r"[\p{L}\p{Nl}\p{No}]", "A")


@cache
def _folds() -> tuple[str, str, str]:
    """Characters of the basic plane that fold to one other character, and to which; those that vanish come last. And a class that holds all that fold to several."""
    single, gone, several = {}, [], []
    for code in (c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7B0):
        folded = _folded_text(chr(code))
        if folded == "":
            gone.append(chr(code))
        elif len(folded) > 1:
            several.append(code)
        elif folded != chr(code).lower() or len(chr(code).lower()) > 1:
            single[chr(code)] = folded
    # few ranges up to Cyrillic, and common punctuation, in which no character folds to several: what lies outside them may
    runs, odd = [], set(several)
    for code in (*range(0x530), *range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x20AC):
        if code in odd:
            continue
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    kind = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)
    return "".join(single) + "".join(gone), "".join(single.values()), f"[^{kind}]"


def _folded_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def fold(text: Column) -> Column:
    """Lower case without accents (compatibility decomposition, combining marks dropped).

    A character map, made from that rule, folds in the JVM; only texts with
    ligatures, Hangul and the like, where one character becomes several, go to Python.
    """
    given, to, several = _folds()
    plain = F.length(text) == F.octet_length(text)
    # the first class is met by few characters and tested fast, so the ranges are tried for those alone
    odd = F.pandas_udf(_folded, "string")(F.when(~plain & text.rlike(rf"[^\x00-\x7f](?<={several})"), text))
    return F.coalesce(odd, F.lower(F.when(plain, text).otherwise(F.translate(text, given, to))))


def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _folded_text(s))


def osa(a: Column, b: Column) -> Column:
    """Edits that make ``b`` of ``a``, where a swap of two neighbours is one and no letter of it is edited again. Neither may be empty.

    Row after row of the table of distances between beginnings, held in arrays.
    """
    x, y = F.split(a, ""), F.split(b, "")

    def cell(last: Column, older: Column, i: Column):
        def add(row: Column, j: Column) -> Column:
            own = F.get(x, i - 1), F.get(y, j - 1)
            swapped = (i > 1) & (j > 1) & (own[0] == F.get(y, j - 2)) & (F.get(x, i - 2) == own[1])
            changed = F.get(last, j - 1) + F.when(own[0] == own[1], 0).otherwise(1)
            best = F.least(F.get(last, j) + 1, F.get(row, j - 1) + 1, changed, F.when(swapped, F.get(older, j - 2) + 1))
            return F.concat(row, F.array(best))

        return add

    def next_row(rows: Column, i: Column) -> Column:
        row = F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(i), cell(rows["last"], rows["older"], i))
        return F.struct(rows["last"].alias("older"), row.alias("last"))

    first = F.sequence(F.lit(0), F.size(y))
    rows = F.aggregate(F.sequence(F.lit(1), F.size(x)), F.struct(first.alias("older"), first.alias("last")), next_row)
    return F.element_at(rows["last"], -1)


def deletions(word: Column, most: int, prefix: int) -> Column:
    """The beginning of a word and what is left of it without up to ``most`` letters, with the fewest that must go: an array of (left, gone).

    Words within some edits of each other share what is left of their
    beginnings when each loses as many letters.
    """
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(prefix))))
    shorter = [F.array(F.substring(word, 1, prefix))]
    for _ in range(most):
        shorter.append(F.array_distinct(F.flatten(F.transform(F.filter(shorter[-1], lambda w: w != ""), less))))
    marked = lambda n: lambda w: F.struct(w.alias("left"), F.lit(n).alias("gone"))
    return F.concat(*(F.transform(ws, marked(n)) for n, ws in enumerate(shorter)))


def allowed_edits(word: Column) -> Column:
    n = F.length(word)
    return F.when(n <= 4, 0).when(n <= 7, 1).otherwise(2)


def name_template(name: Column) -> Column:
    """The stem of a file name with what varies in it shown by class, and the extension."""
    dotted = F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)
    stem, ext = F.when(dotted == "", name).otherwise(dotted), F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    parts = F.regexp_extract_all(stem, F.lit(r"[^_\-. ]+|[_\-. ]"), F.lit(0))
    whole = F.array_join(F.transform(parts, _token_class), "")
    return F.when(ext == "", whole).otherwise(F.concat(whole, F.lit("."), ext))


def _token_class(t: Column) -> Column:
    sized = lambda kind: F.concat(F.lit(f"<{kind}"), F.length(t).cast("string"), F.lit(">"))
    return (
        F.when(t.rlike(r"(?i)^[0-9a-f]{16,}$"), sized("hex"))
        .when(t.rlike(f"^{YEAR}s?$"), F.lit("<year>"))
        .when(t.rlike(r"^\d+$"), sized("n"))
        .when(t.rlike(r"^[A-Za-z]+\d+$"), F.concat(F.regexp_replace(t, r"\d+$", ""), F.lit("<n>")))
        .otherwise(t)
    )


def template_meaning(template: Column, example: Column) -> Column:
    """What names of a template tell, the first that fits."""
    stem = F.regexp_replace(template, r"\.[^.]*$", "")
    literal = F.regexp_replace(F.regexp_replace(stem, "<[^>]*>", ""), r"^[_\-. ]+|[_\-. ]+$", "")
    return (
        F.when(literal.rlike(CAMERA), "camera default name, carries no information")
        .when(stem.contains("<hex"), "hash or UUID name, carries no readable information")
        .when(stem.contains("<year>") | example.rlike(YEAR), "may contain a year that can be extracted")
        .when(stem.contains("<") & (F.length(literal) >= 3), F.concat(F.lit("fixed prefix '"), F.substring(literal, 1, 16), F.lit("' plus a serial number, possibly a catalog number")))
        .when(literal == "", "carries no usable information")
        .otherwise("")
    )


_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&"}


def _references(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else html.unescape(s))


def _unmarked(text: Column) -> Column:
    """Without tags, and with character references read: the commonest in the JVM, texts with others in Python."""
    bare = F.regexp_replace(text, r"<(/?[A-Za-z]|!)[^>]*>", "")
    left = F.regexp_replace(bare, f"&({'|'.join(_ENTITIES)});", "")
    read = F.pandas_udf(_references, "string")(F.when(left.rlike("&(#|[A-Za-z])"), bare))
    for name, sign in _ENTITIES.items():
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    return F.coalesce(read, bare)


def plain_text(text: Column) -> Column:
    """Catalog text without markup and with all named and numeric character references read; markup that was escaped, too, is read once more."""
    once = _unmarked(text)
    escaped = text.rlike(r"(?i)&lt;/?(b|em|i|strong|sub|sup|u)&gt;")
    return F.when(~text.rlike("[<&]"), text).when(escaped, _unmarked(once)).otherwise(once)


def human_bytes(value: Column) -> Column:
    """``512 B``, ``1.5 KB`` and so on up to terabytes."""
    value, out = value.cast("double"), None
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        shown = F.concat(F.format_number(value / 1024**power, 1 if power else 0), F.lit(f" {unit}"))
        fits = F.abs(value) < 1024 ** (power + 1)
        out = F.when(fits, shown) if out is None else out.otherwise(shown) if unit == "TB" else out.when(fits, shown)
    return out


def human_duration(seconds: Column) -> Column:
    """``2 h 5 min``, ``5 min 10 s`` or ``10 s``."""
    s = F.floor(seconds).cast("long")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    part = lambda c: F.floor(c).cast("string")
    return F.when(s >= 3600, text(part(s / 3600), " h ", part(s % 3600 / 60), " min")).when(s >= 60, text(part(s / 60), " min ", part(s % 60), " s")).otherwise(text(s.cast("string"), " s"))


def clock(seconds: Column) -> Column:
    """``01:02:03``; dashes for what is unknown or endless."""
    s = F.floor(F.when((seconds >= 0) & (seconds < 1e15), seconds)).cast("long")
    shown = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s.isNotNull(), shown).otherwise("--:--:--")


# --- dates -------------------------------------------------------------------


def years(value: Column) -> tuple[Column, Column]:
    """First and last year that a catalog date names; nulls where it names none.

    ``1860s`` is a decade, or a century for multiples of 100 before 1500;
    ``1914-1918`` a span in either order; ``1860`` itself.
    """
    parts = r"^\s*(\d{1,4})(?:(s)|\s*[-–]\s*(\d{1,4}))?\s*$"
    first, last = (F.nullif(F.regexp_extract(value, parts, i), F.lit("")).try_cast("int") for i in (1, 3))
    decade = F.regexp_extract(value, parts, 2) == "s"
    end = F.when(decade, F.when((first % 100 == 0) & (first < 1500), first + 99).otherwise(first + 9)).otherwise(F.greatest(first, last))
    return F.least(first, last), end


def is_query_date(word: Column) -> Column:
    """A year from 1000 to 2099, or a decade of those."""
    return word.rlike(r"(?i)^(1[0-9]|20)[0-9]{2}$|^(1[0-9]|20)[0-9]0s$")


def date_forms(word: Column) -> Column:
    """A query's year and its decade, or the decade alone."""
    year = F.lower(word)
    return F.array_distinct(F.array(year, F.when(year.endswith("s"), year).otherwise(F.concat(F.substring(year, 1, 3), F.lit("0s")))))


def hours_since(moment: Column, now: Column) -> Column:
    """Hours from an ISO time (UTC) to now."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.to_timestamp(moment))) / 3.6e9


# --- images and sizes --------------------------------------------------------


def stored_pixels(width: Column, height: Column, edges: tuple[int, ...] = (400, 1920)) -> Column:
    """Pixels of the copies of an image whose longest edges are cut to ``edges``, never enlarged."""
    longest = F.greatest(width, height)
    return sum((width * height * F.pow(F.least(F.lit(1.0), F.lit(float(e)) / longest), 2) for e in edges), F.lit(0.0))
