"""Text as columns: name normalisation, ordered classification rules, image links, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A category is the first whose pattern is found in the normalised name; patterns and category ids have
# to be these for equal results.
URBAN_RULES = [
    (r"osvetl", "osvetljenje"),
    (r"\bklup", "klupe"),
    (r"kant|konten?jer", "kante"),
    (r"l[ej]tn?[ij]+kovac", "letnjikovci"),
    (r"sport|vezban|odbojk|kosh?ar|fudbal|teren", "sport"),
    (r"decji|deciji|mobilijar", "decji_mobilijar"),
]
SURFACE_RULES = [
    (r"asfalt", "asfalt"),
    (r"poplo[cč]an|kaldrm", "popločana"),
    (r"zemlj?[ae]n", "zemljana"),
]
GREEN_RULES = [
    (r"vi?oska? veget|visoka veget", "visoka_vegetacija"),
    (r"niska veget", "niska_vegetacija"),
    (r"izvire|^voda$|izvor", "izvor_vode"),
    (r"cesma|česma", "cesma"),
]
STATE_RULES = [
    (r"lo[sš]e? stanj|lose stanje|loshe stanje", "loše"),
    (r"srednje stanj", "srednje"),
    (r"dobro stanj", "dobro"),
    (r"deponij", "deponija"),
]
OBSTACLE_RULES = [
    (r"dalekovod", "dalekovod"),
    (r"njiv|privatn", "privatno_zemljiste"),
    (r"most", "most_prelaz"),
    (r"bedem", "bedem"),
    (r"kutinsk|reka|potok|pritok", "pritoka"),
    (r"(?s)^(?=.*nedostatak)(?=.*ramp)", "nedostatak_rampe"),
    (r"(?s)^(?=.*nedostatak)(?=.*(?:stepenist|stepenic))", "nedostatak_stepenista"),
    (r"objekat|objekt|ograd", "objekat"),
    (r"zemljen|zemljan", "promena_puta"),
]
STAIR_RULES = [(r"stepenic", "stepenice"), (r"rampa|rampe", "rampe")]
#: Source layers by what their name holds, in order; a folder that matches none is counted but not shown.
LAYER_RULES = [
    (r"Indicaciones", "trasa"),
    (r"Zelena", "zelena"),
    (r"Prekid", "prekidi"),
    (r"Stepenice i rampe", "stepenice_rampe"),
    (r"Urbana oprema", "urbana"),
    (r"Stanja", "stanja"),
    (r"Javni socijalni|(?i:urbani dzepovi)", "socijalni"),
]
URBAN_BUCKETS = ("osvetljenje", "klupe", "kante", "letnjikovci", "sport")
CATCH_ALL, URBAN_REST = "ostalo", "urbana_ostalo"
URL_PATTERN = r"(?iU)https?://\S+"
EMAIL_PATTERN = r"(?U)\S+@\S+\.\S+"
PHONE_PATTERN = r"(?U)\b0\d{1,2}[/\s.\-]?\d{2,4}[/\s.\-]?\d{2,4}\b"
SIZE_PATTERN = r"\bfife=s\d+\b"
#: Colours of survey answers by what the lower-case label holds or is, in order, and for other labels by turn.
TONE_RULES = [
    (r"сигурно|^да$|свакодневно", "#2f6b46"),
    (r"неколико пута", "#4a9367"),
    (r"повремено|можда|викенд", "#d8a93a"),
    (r"информи|нисам сигуран", "#9aa5a2"),
    (r"^не$|никад", "#c0392b"),
]
TONE_PALETTE = ("#2f6b46", "#4a9367", "#d8a93a", "#c08a4f", "#4f87a5", "#9aa5a2", "#c0392b")
UNNAMED = "(bez imena)"
POPUP_NOTE = ('<br><span class="muted">', "</span>")
POPUP_IMAGES = ('<div class="popup-images">', "</div>")
POPUP_IMAGE = ('<a href="', '" target="_blank" rel="noopener"><img src="', '" alt="" loading="lazy"></a>')
IMAGE_PATTERN = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
# End of fixed values.


def normalize(name: Column) -> Column:
    """Trimmed, lower case, each run of white space one space; white space as Unicode has it."""
    trimmed = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|(?<!\s)\s++$", "")
    return F.regexp_replace(F.lower(trimmed), r"(?U)\s+", " ")


def classify(name: Column, rules: Sequence[tuple[str, str]], default: str | None = CATCH_ALL) -> Column:
    """The label of the first rule whose pattern is found."""
    out = None
    for pattern, label in rules:
        found = name.rlike(pattern)
        out = F.when(found, label) if out is None else out.when(found, label)
    return (out if out is not None else F.when(F.lit(False), "")).otherwise(default)


def stairs_or_ramp(name: Column) -> Column:
    """Stairs come first, and are what an unclear name counts as."""
    return classify(name, STAIR_RULES, "stepenice")


def layer_of(folder: Column) -> Column:
    return classify(folder, LAYER_RULES, None)


def bucket(category: Column, own: Sequence[str] = URBAN_BUCKETS, rest: str = URBAN_REST) -> Column:
    return F.when(category.isin(*own), category).otherwise(rest)


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key, or the key itself."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def image_urls(html: Column) -> Column:
    """Image sources in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(IMAGE_PATTERN), 1))


def hrefs(html: Column) -> Column:
    """Link targets in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("""href=["']([^"']+)["']"""), 1))


def resized(url: Column, size: int = 1024) -> Column:
    """An image address with its size parameter, if it has one, set anew."""
    return F.regexp_replace(url, SIZE_PATTERN, f"fife=s{size}")


def content_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def redact(comment: Column) -> Column:
    """Links, then e-mail addresses, then telephone numbers replaced; then trimmed."""
    t = F.regexp_replace(F.coalesce(comment, F.lit("")), URL_PATTERN, "[link]")
    # A match is a whole run of non-blanks: it has an @ but as its first sign, and after the first of these a dot within. So
    # each run is tried from its start alone, with one @, and is read a fixed number of times however many it has.
    t = F.regexp_replace(t, r"(?U)(?<!\S)\S[^\s@]*+@\S+\.\S+", "[e-mail]")
    t = F.regexp_replace(t, PHONE_PATTERN, "[telefon]")
    return F.regexp_replace(t, r"(?U)^\s+|(?<!\s)\s++$", "")


def metres(m: Column) -> Column:
    """1234 as '1.23 km', 999 as '999 m'."""
    return F.when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(F.format_string("%d m", F.floor(m + 0.5)))


def stripped(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|(?<!\s)\s++$", "")


def popup(name: Column, length_m: Column, images: Column, base: str = "", last: Mapping[str, Column] | None = None, **notes: Column) -> Column:
    """HTML of a feature: its name in bold, a line for each note that is there, its length, a line for each last note, its images as links."""
    line = lambda label, value: F.concat(F.lit(POPUP_NOTE[0] + label + ": "), value, F.lit(POPUP_NOTE[1]))
    lines = lambda of: [F.when(F.length(c) > 0, line(k, c)) for k, c in of.items()]
    length = F.when(length_m > 0, line("dužina", F.concat(F.floor(length_m + 0.5).cast("string"), F.lit(" m"))))
    link = lambda u: F.concat(F.lit(POPUP_IMAGE[0] + base), u, F.lit(POPUP_IMAGE[1] + base), u, F.lit(POPUP_IMAGE[2]))
    shown = F.when(F.size(images) > 0, F.concat(F.lit(POPUP_IMAGES[0]), F.array_join(F.transform(images, link), ""), F.lit(POPUP_IMAGES[1])))
    title = F.concat(F.lit("<strong>"), F.coalesce(F.nullif(stripped(name), F.lit("")), F.lit(UNNAMED)), F.lit("</strong>"))
    return F.concat_ws("", title, *lines(notes), length, *lines(last or {}), shown)


def deep_link(base: str, lat: Column, lon: Column, zoom: Column, at: Column) -> Column:
    """A sun map's address for a place at a time, in epoch milliseconds."""
    return F.format_string(f"{base}/@%.5f,%.5f,%dz,%dt,0b,0p,1m", lat, lon, zoom, F.unix_millis(at))


def tone(label: Column, rules: Sequence[tuple[str, str]], palette: Sequence[str], place: Column) -> Column:
    """A colour by keyword, or the palette's next."""
    turn = F.element_at(F.array(*[F.lit(c) for c in palette]), (place % len(palette) + 1).cast("int"))
    return F.coalesce(classify(F.lower(F.coalesce(label, F.lit(""))), rules, None), turn)
