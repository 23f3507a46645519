"""Scalar functions as Spark expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdgraph.functions.codelists import HOMOGLYPHS

_TENS = list(range(0, 30))


def stable_id(*parts: Column, prefix: str = "hg-") -> Column:
    """Prefix of the SHA-256 of the parts joined by '|'; null parts count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 24))


def _values(text: Column) -> Column:
    """0-9 and A-Z as 0..35; other characters are null."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)


def normalised_lei(value: Column) -> Column:
    return F.upper(F.trim(value))


def lei_shape(value: Column) -> Column:
    return normalised_lei(value).rlike("^[A-Z0-9]{18}[0-9]{2}$")


def mod97(text: Column) -> Column:
    """The number that the characters spell (letters as two digits), modulo 97."""
    step = lambda acc, v: F.when(v >= 10, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)
    return F.aggregate(_values(text), F.lit(0), lambda acc, v: step(acc, v).cast("int"))


def lei_ok(value: Column) -> Column:
    """ISO 17442 shape and ISO 7064 check digits."""
    return F.coalesce(lei_shape(value) & (mod97(normalised_lei(value)) == 1), F.lit(False))


def isin_ok(value: Column) -> Column:
    """Shape, then Luhn over the digits after letters are spelled out."""
    text = F.upper(F.trim(value))
    digits = F.flatten(F.transform(_values(text), lambda v: F.when(v >= 10, F.array((v / 10).cast("int"), v % 10)).otherwise(F.array(v))))
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d.cast("int"))
    return F.coalesce(text.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & (total % 10 == 0), F.lit(False))


def weighted_mod(text: Column, weights: list[int]) -> Column:
    """Sum of digit times weight over the leading digits."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.substring(text, k + 1, 1).cast("int") * w
    return total


def business_id_ok(value: Column) -> Column:
    """Finnish business identity code: seven digits, a dash, a check digit modulo 11."""
    text = F.trim(value)
    rest = F.pmod(-weighted_mod(text, [7, 9, 10, 5, 8, 4, 2]), F.lit(11))
    return F.coalesce(text.rlike("^[0-9]{7}-[0-9]$") & (rest != 10) & (rest == F.substring(text, 9, 1).cast("int")), F.lit(False))


def organisation_number_ok(value: Column) -> Column:
    """Swedish organisation number: ten digits that pass Luhn."""
    text = F.regexp_replace(F.trim(value), "[- ]", "")
    return F.coalesce(text.rlike("^[0-9]{10}$") & F.call_function("luhn_check", text), F.lit(False))


def cnpj_ok(value: Column) -> Column:
    """Brazilian company number: fourteen digits with two check digits modulo 11."""
    text = F.regexp_replace(F.trim(value), "[^0-9]", "")
    check = lambda w: F.when(weighted_mod(text, w) % 11 < 2, 0).otherwise(11 - weighted_mod(text, w) % 11)
    first, second = check([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]), check([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
    return F.coalesce((F.length(text) == 14) & (F.substring(text, 13, 1).cast("int") == first) & (F.substring(text, 14, 1).cast("int") == second), F.lit(False))


def qid_ok(value: Column) -> Column:
    return F.coalesce(value.rlike("^Q[1-9][0-9]{0,17}$"), F.lit(False))


def fold_homoglyphs(value: Column) -> Column:
    return F.translate(value, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def canonical_identifier(value: Column, least: int = 7) -> Column:
    """Capitals and digits alone, null when too short to tell anything."""
    text = F.regexp_replace(F.upper(fold_homoglyphs(F.trim(value))), "[^A-Z0-9]", "")
    return F.when(F.length(text) >= least, text)


def canonical_url(value: Column) -> Column:
    text = F.rtrim(F.regexp_replace(F.lower(F.trim(value)), "^https?://", ""), F.lit("/"))
    return F.when(text != "", text)


def rounded_date(value: Column) -> Column:
    """YYYY and YYYY-MM filled up to a day; other texts as they are."""
    return F.when(value.rlike("^[0-9]{4}$"), F.concat(value, F.lit("-01-01"))).when(value.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(value, F.lit("-01"))).otherwise(value)


def date_precision(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{4}$"), "year").when(value.rlike("^[0-9]{4}-[0-9]{2}$"), "month").when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "day")


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def human_date(value: Column) -> Column:
    """'3 May 2021' of an ISO beginning; null where the month is out of range. The day isn't checked."""
    month = F.substring(value, 6, 2).try_cast("int")
    name = F.element_at(F.array(*map(F.lit, _MONTHS)), F.when(month.between(1, 12), month).otherwise(1))
    shown = F.concat_ws(" ", F.substring(value, 9, 2).try_cast("int").cast("string"), name, F.substring(value, 1, 4))
    return F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & month.between(1, 12), shown)


def number_text(x: Column) -> Column:
    """At most six significant digits, without trailing zeros (for magnitudes that need no exponent)."""
    whole = F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))).cast("int")
    text = F.when(whole >= 5, F.format_string("%.0f", x)).when(whole == 4, F.format_string("%.1f", x)).when(whole == 3, F.format_string("%.2f", x)).when(whole == 2, F.format_string("%.3f", x)).when(whole == 1, F.format_string("%.4f", x)).otherwise(F.format_string("%.5f", x))
    return F.when(x == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def share_text(share: Column) -> Column:
    """A share as text: exact, else a range 'lo-hi' ('>' before an exclusive bound), '>lo', '>=lo', '<=hi'."""
    g = share.getField
    low, high = F.coalesce(g("minimum"), g("exclusiveMinimum")), F.coalesce(g("maximum"), g("exclusiveMaximum"))
    over = F.when(g("minimum").isNull() & g("exclusiveMinimum").isNotNull(), ">").otherwise("")
    return (
        F.when(share.isNull(), "")
        .when(g("exact").isNotNull(), number_text(g("exact")))
        .when(low.isNotNull() & high.isNotNull() & (low == high), number_text(low))
        .when(low.isNotNull() & high.isNotNull(), F.concat(number_text(low), F.lit("-"), number_text(high)))
        .when(low.isNotNull(), F.concat(F.when(over == ">", ">").otherwise(">="), number_text(low)))
        .when(high.isNotNull(), F.concat(F.lit("<="), number_text(high)))
        .otherwise("")
    )


def slug(value: Column, most: int = 60) -> Column:
    """Lower-case letters and digits with hyphens between, for addresses."""
    text = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(text, 1, most), "-$", "")


def percent_of(proportion: Column) -> Column:
    return F.when(proportion <= 1, proportion * 100).otherwise(proportion)


def split_values(cell: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(cell, mark), lambda x: F.trim(x)), lambda x: x != "")


def plain_name(name: Column) -> Column:
    """Lower case, punctuation to blanks, blanks squashed; for names that are already Latin."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def screenable(name: Column) -> Column:
    """Three characters at least once blanks and punctuation are gone."""
    return F.length(F.replace(plain_name(name), F.lit(" "), F.lit(""))) >= 3


def matchable(normal: Column) -> Column:
    """Two words at least, or two characters of a script that is written without blanks."""
    dense = normal.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")
    return (F.instr(normal, " ") > 0) | (dense & (F.length(normal) >= 2))


def sorted_tokens(normal: Column, without: tuple[str, ...] = ()) -> Column:
    tokens = F.filter(F.split(normal, " "), lambda t: (t != "") & ~t.isin(list(without))) if without else F.filter(F.split(normal, " "), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice_of(left: Column, right: Column) -> Column:
    """Twice the shared bigrams (counted with repeats) over all; of arrays that are columns already."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(left), F.lit(0), lambda acc, x: acc + F.least(count(left, x), count(right, x)))
    total = F.size(left) + F.size(right)
    return F.when(total > 0, 2.0 * shared / total).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    """dice_of two texts."""
    return dice_of(bigrams(a), bigrams(b))


def token_gate(a: Column, b: Column) -> Column:
    """Distinctive tokens agree: numbers and single characters are the same on both sides, and each token
    of the shorter list is in the longer one, exactly or (from four characters) within one edit."""
    hard = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda t: (F.length(t) == 1) | t.rlike("^[0-9]+$"))))
    near = lambda t, u: (t == u) | ((F.length(t) >= 4) & (F.levenshtein(t, u, 1) >= 0))
    covered = lambda small, large: F.forall(small, lambda t: F.exists(large, lambda u: near(t, u)))
    return (F.size(a) > 0) & (F.size(b) > 0) & (hard(a) == hard(b)) & F.when(F.size(a) <= F.size(b), covered(a, b)).otherwise(covered(b, a))


def address_tier(paf_a: Column, paf_b: Column, address_a: Column, address_b: Column) -> Column:
    """high for one postal point, medium for equal texts or token Jaccard from 0.6, else low."""
    ta, tb = (F.array_distinct(F.filter(F.split(plain_name(x), " "), lambda t: t != "")) for x in (address_a, address_b))
    union = F.size(F.array_union(ta, tb))
    jaccard = F.when(union > 0, F.size(F.array_intersect(ta, tb)) / union).otherwise(0.0)
    return F.when(paf_a == paf_b, "high").when((plain_name(address_a) == plain_name(address_b)) | (jaccard >= 0.6), "medium").otherwise("low")


def nature_of_control(nature: Column) -> Column:
    """A filed nature of control as an interest type and a share band."""
    low = F.lower(nature)
    kind = F.when(low.startswith("ownership-of-shares"), "shareholding").when(low.startswith("voting-rights"), "votingRights").when(low.rlike("^right-to-appoint-and-remove-(directors|members|person)"), "appointmentOfBoard").when(low.rlike("^(part-)?right-to-share-surplus-assets"), "rightsToSurplusAssetsOnDissolution").otherwise("otherInfluenceOrControl")
    part = lambda k: F.regexp_extract(low, "([0-9]+)-to-([0-9]+)-percent", k)
    return F.struct(kind.alias("type"), F.when(part(1) != "", part(1).cast("double")).alias("exclusiveMinimum"), F.when(part(2) != "", part(2).cast("double")).alias("maximum"))
