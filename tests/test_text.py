"""Text scalars on rows made for their corner cases."""

from pyspark.sql import functions as F

from panelweave.functions import text as T
from panelweave.sources import files


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_person_names(spark):
    t = spark.createDataFrame([("Smith, Jr",), ("Dr. John (Jack) Q. Doe, MD, Chief",), ("Anna  Lee-Park III",), ("St. Mary",), ("Núñez",), ("",), (None,)], "n string")
    n = F.col("n")
    p = T.person_parts(n)
    got = rows(t.select(T.drop_suffixes(n), T.nickname(n), T.drop_nickname(n), p.first, p.last, p.title, T.ascii_fold(n)))
    assert got == [
        ("Smith", None, "Smith, Jr", "Smith", None, "Jr", "Smith, Jr"), ("Dr. John (Jack) Q. Doe, MD, Chief", "Jack", "Dr. John Q. Doe, MD, Chief", "Dr.", "Doe", "MD, Chief", "Dr. John (Jack) Q. Doe, MD, Chief"),
        ("Anna Lee-Park", None, "Anna Lee-Park III", "Anna", "Lee-Park", None, "Anna  Lee-Park III"), ("St. Mary", None, "St. Mary", "St.", "Mary", None, "St. Mary"), ("Núñez", None, "Núñez", "Núñez", None, None, "Nunez"),
        ("", None, "", None, None, None, ""), (None,) * 7,
    ]


def test_numbers_in_texts(spark):
    s = F.col("s")
    t = spark.createDataFrame([("00012",), ("12345-6789",), (" 7 ",), ("(800) 555-0100 x12",), ("0",), (None,)], "s string")
    assert rows(t.select(T.strip_zeros(s), T.to_number(s), T.zip5(s), T.digits(s), T.pad_id(s))) == [
        ("12", 12.0, "00012", "00012", "000012"), ("12345-6789", None, "12345", "123456789", "12345-6789"), (" 7 ", 7.0, "00007", "7", "000 7 "), ("(800) 555-0100 x12", None, "80055", "800555010012", "(800) 555-0100 x12"), ("0", 0.0, "00000", "0", "000000"), (None,) * 5]


def test_addresses(spark):
    pairs = [("12 North First Street", "12 n 1st st"), ("5 Oak Trail, Suite 4", "5 oak trl ste 4"), ("9 East Terrace-Square", "9 e ter sq"), ("Northern Road", "northern rd"), ("77 Tenth Parkway Court", "77 10th pkwy ct"), ("", ""), (None, None)]
    t = spark.createDataFrame(pairs, "a string, b string")
    assert [(r.a, r.got) for r in t.withColumn("got", T.standard_address(F.col("a"))).collect()] == pairs


def test_words(spark):
    t = spark.createDataFrame([("Saint Mary Hospital", "Mary"), ("J", "john"), ("Johnn", "john"), ("Jo", "Jonathan"), ("Health (a.b) Center", "x"), ("", "x")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert rows(t.select(T.first_word(a), T.contains_either(a, b), T.drop_words(a, ["saint", "hospital", "a.b"]), T.format_share(F.lit(0.125)), T.initials_match(a, b))) == [
        ("saint mary", True, "Mary", "12.5%", False), ("j", False, "J", "12.5%", True), ("johnn", False, "Johnn", "12.5%", True), ("jo", True, "Jo", "12.5%", False), ("health", False, "Health ( ) Center", "12.5%", False), ("", False, "", "12.5%", False)]


def test_spaces_lists_and_extensions(spark):
    t = spark.createDataFrame([(" a b \t c\u0007", "p; q ;r", "555-0100 ext 12"), ("x​", "qq;s", "555-0100 x7"), (None, None, None)], "s string, l string, p string")
    assert rows(t.select(T.plain_space(F.col("s")), T.in_list(F.col("l"), F.lit("q")), T.in_list(F.col("l"), F.lit("qq")), T.strip_extension(F.col("p")))) == [("a b c", True, False, "5550100"), ("x", False, True, "5550100"), (None,) * 4]


def test_token_sort_ratio(spark):
    t = spark.createDataFrame([("b a", "a b"), ("main st 5", "5 main street"), ("x", "y"), ("", ""), (None, "a")], "a string, b string")
    assert rows(t.select(F.round(T.token_sort_ratio(F.col("a"), F.col("b")), 4))) == [(100.0,), (81.8182,), (0.0,), (100.0,), (None,)]


def test_dates_in_pages(spark):
    t = spark.createDataFrame([(1, "on 2012-03-04 it"), (2, "December 1, 2009"), (3, "January 05, 2010 - x"), (4, "no date"), (5, None)], "i int, html string")
    assert [str(r.date) for r in files.page_fields(t).orderBy("i").collect()] == ["2012-03-04", "2009-12-01", "2010-01-05", "None", "None"]


def test_faulty_and_ragged_files(spark, tmp_path):
    def lines(name, values):
        spark.createDataFrame([(x,) for x in values], "value string").coalesce(1).write.text(str(tmp_path / name))
        return str(tmp_path / name)

    audit = files.parse_audit(spark, lines("a", ["k,v", "1,2.5", "2,x", "3,4", "y,5", "6,"]), "k int, v double").first()
    assert (audit.rows, audit.bad) == (5, 2)
    assert files.tolerant_csv(spark, lines("b", ["1,a", "2,b,c,d", "3,e", "z,f", "4,g", "5,h"]), "k int, v string").count() == 4
    pairs = files.equivalent_pairs(files.ragged_csv(spark, lines("c", ["Bob,Robert,Rob,NA", "ann, Anna,,", "zoe", ""])))
    assert {tuple(r) for r in pairs.collect()} == {("ann", "anna"), ("anna", "ann"), ("bob", "rob"), ("bob", "robert"), ("rob", "bob"), ("rob", "robert"), ("robert", "bob"), ("robert", "rob")}


def test_sheets(spark):
    rows = [("a/b", 2, "y"), ("a/b", 1, "x"), ("a:b", 5, None), (None, 7, "n"), ("x" * 40, 1, "l"), ("[]", 3, "e"), ("a/b", 1, "x")]
    got = files.sheet_rows(spark.createDataFrame(rows, "k string, v int, t string"), "k").collect()
    sheets = {}
    for r in sorted(got, key=lambda r: (r.sheet, r.row)):
        sheets.setdefault(r.sheet, []).append((r.v, r.t) if r.filled else None)
    assert sheets == {"a b": [(1, "x"), (1, "x"), (2, "y")], "a b 2": [(5, None), None, None], "sheet": [(7, "n"), None, None], "sheet 2": [(3, "e"), None, None], "x" * 31: [(1, "l"), None, None]}
    assert files.sheet_rows(spark.createDataFrame([], "k string, v int, t string"), "k").count() == 0
