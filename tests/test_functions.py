"""Column functions against small tables of inputs and expected values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import address, categories, geo, links, scoring, similarity
from vouch.functions import signals as sg
from vouch.functions import text as tx


def column(spark, values, expr, schema="v string"):
    """Evaluate one column expression over many values in one job."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema).repartition(2)
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def detected(spark, rows, country=None):
    df = spark.createDataFrame([(i, k, t, None, country) for i, (k, t) in enumerate(rows)],
                               "i int, kind string, text string, url string, country string")
    out = sg.field_signals(df, sg.Lexicon.default(), country="country" if country else None)
    out = out.select("i", sg.strongest(F.col("signals")).alias("s"))
    return [[(x.signal, x.weight, x.snippet) for x in r.s] for r in out.orderBy("i").collect()]


def test_script_class(spark):
    table = {
        "گلفروشی پروانه": "persian_definitive", "نوای باران": "persian_likely",
        "مكتبة النجمة": "other", "د ګلونو پلورنځی": "other",
        "ٹماٹر چاٹ گھر": "other", "Laleh Persian Bistro": "none", "گلدستہ نظم": "other",
        "د نجیب سفرونه": "other", "ﭼﺎﭖ": "persian_definitive",
    }
    got = column(spark, list(table), tx.script_class(tx.nfkc("v")))
    assert got == list(table.values())
    assert column(spark, ["دانه", "کباب دربند"], tx.script_class("v")) != ["other", "other"]


def test_name_split(spark):
    """The Arabic-script run and what stands around it; each side alone; outer separators go."""
    cases = {
        "Cedar (پنجره) Hall": ("پنجره", "Cedar ( ) Hall"),
        "پنجره / Cedar": ("پنجره", "Cedar"),
        "[Cedar] – پنجره": ("پنجره", "Cedar"),
        "  Cedar  Hall ": (None, "Cedar  Hall"),
        "پنجره چوبی": ("پنجره چوبی", None),
        "": (None, None),
    }
    persian, latin = tx.split_name("v")
    assert column(spark, list(cases), persian) == [p for p, _ in cases.values()]
    assert column(spark, list(cases), latin) == [n for _, n in cases.values()]


#: Which list of the lexicon makes which signal of a name.
LIST_SIGNALS = {
    "explicit": "explicit_keyword", "places": "iranian_place_name",
    "places_ambiguous": "iranian_place_name", "place_adjectives": "persian_personal_name",
    "foods": "iranian_food_terms", "occasions": "nowruz_yalda_mentions",
    "negative": "negative_keyword",
}


def test_each_list_makes_its_signal_and_near_misses_none(spark):
    lists = {k: v.strip().splitlines() for k, v in fv.DEFAULT_LEXICON.items()}
    latin = {k: [t for t in lists[k] if t.isascii()][::7] for k in LIST_SIGNALS}
    hits = [(k, f"Unit {t.upper()} 24") for k, terms in latin.items() for t in terms]
    misses = [(k, f"Unit q{t}q 24") for k, terms in latin.items() for t in terms]
    found = [{s[0] for s in row} for row in detected(spark, [("name", n) for _, n in hits + misses])]
    for (k, name), signals in zip(hits, found, strict=False):
        assert LIST_SIGNALS[k] in signals, name
    assert all(not signals for signals in found[len(hits):])


def test_rules_of_names(spark):
    """One case a rule: a hit, its near miss, and rules that meet."""
    lists = {k: v.strip().splitlines() for k, v in fv.DEFAULT_LEXICON.items()}
    product, adjective = lists["product_terms"][0], lists["product_adjectives"][0]
    place, food, suffix = lists["places"][0], lists["foods"][0], lists["surname_suffixes"][0]
    cases = [
        (f"{adjective} {product}", {"persian_product_term"}),
        (f"{adjective} lamps", {"explicit_keyword"}),
        (f"green {product}", set()),
        (f"Dr Olm{suffix.lower()}", {"persian_personal_name"}),
        (f"{suffix} lamps", set()),
        (f"{place} {food}", {"iranian_place_name", "iranian_food_terms"}),
        (f"{lists['negative'][0]} {food}", {"negative_keyword", "iranian_food_terms"}),
        ("پنجره چوبی", {"persian_script_name"}),
        ("شباك", set()),
    ]
    found = [{s[0] for s in row} for row in detected(spark, [("name", n) for n, _ in cases])]
    assert dict(zip([n for n, _ in cases], found, strict=True)) == dict(cases)


def test_labels_follow_the_score(spark):
    weights = [(), (0.3,), (0.6,), (0.6, 0.5), (0.8, 0.6)]
    array = F.transform("v", lambda w, i: F.struct(
        F.concat(F.lit("s"), i.cast("string")).alias("signal"), w.alias("weight")))
    scores = column(spark, [([float(x) for x in w],) for w in weights], sg.signal_score(array),
                    "v array<double>")
    want = []
    for w in weights:
        rest = 1.0
        for x in w:
            rest *= 1 - x
        want.append(round(1 - rest, 6))
    assert [round(s, 6) for s in scores] == want
    labels = column(spark, scores, scoring.confidence_label("v"), "v double")
    assert labels[0] is None and labels[-1] == "high" and labels == sorted(
        labels, key=lambda x: [None, "low", "medium", "high"].index(x))


def test_keyword_rules(spark):
    rows = [
        ("name", "Iranian Rug Room"),
        ("name", "نوای باران"),
        ("text", "نان تازه ایرانی در ونکوور"),
        ("page", "نان تازه ایرانی در ونکوور"),
        ("page", "Persian stews. Prices in EUR or AFGHANI. Turkish tea too."),
        ("page_head", "Mantu and Afghan Bread in Calgary"),
        ("name", "Our koobideh comes with tahdig; ask for the Nowruz menu"),
        ("text", "وکیل فارسی‌زبان"),
        ("text", "وکیل فارسي زبان"),
        ("name", "مطعم مکلا الجدید"),
        ("name", "مطعم إيراني"),
        ("text", "Beşiktaş'ta İranlı usta lokantası"),
        ("name", "persianés"),
        ("name", "   "),
    ]
    got = [{s[0]: s for s in row} for row in detected(spark, rows)]
    assert "explicit_keyword" in got[0]
    assert got[1]["persian_script_name"][1] == pytest.approx(0.25)
    assert "persian_script_text" in got[2] and "explicit_keyword" in got[2]
    assert set(got[3]) == {"explicit_keyword"}
    assert set(got[4]) == {"explicit_keyword"}
    assert "negative_keyword" in got[5]
    assert {"iranian_food_terms", "nowruz_yalda_mentions"} <= set(got[6])
    assert "explicit_keyword" in got[7] and "explicit_keyword" in got[8]
    assert "negative_keyword" in got[9]
    assert set(got[10]) == {"explicit_keyword"}
    assert got[11]["explicit_keyword"][2] == "Beşiktaş'ta İranlı usta lokantası"
    assert got[12] == {} and got[13] == {}


def test_other_languages(spark):
    names = ["Persisk frisör Malmö", "Iranska Bageriet", "Perzisch Eethuis Utrecht",
             "Iraanse bakker", "İranlı Terzi", "Farsça konuşan avukat"]
    for row in detected(spark, [("name", n) for n in names]):
        assert "explicit_keyword" in {s[0] for s in row}


def test_country_exclusions(spark):
    rows = [("name", "Persan Unlu Mamuller"), ("name", "İranlı Restoran")]
    assert "explicit_keyword" in {s[0] for s in detected(spark, rows)[0]}
    assert "explicit_keyword" in {s[0] for s in detected(spark, rows, "FR")[0]}
    turkey = detected(spark, rows, "TR")
    assert "explicit_keyword" not in {s[0] for s in turkey[0]}
    assert "explicit_keyword" in {s[0] for s in turkey[1]}


def test_snippet_cuts_context(spark):
    text = "a" * 100 + " Persian " + "b" * 100
    ((_, _, snippet),) = detected(spark, [("text", text)])[0]
    assert snippet == "…" + "a" * 59 + " Persian " + "b" * 59 + "…"


def test_every_positive_text_passes_the_coarse_test(spark):
    lex = sg.Lexicon.default()
    lists = {k: v.strip().splitlines() for k, v in fv.DEFAULT_LEXICON.items()}
    names = [f"Unit {t} 24" for k, s in LIST_SIGNALS.items() if s != "negative_keyword"
             for t in lists[k]]
    assert all(column(spark, names, lex.any_positive(tx.fold("v"), F.col("v"))))


def test_links(spark):
    table = [
        ("https://www.Instagram.com/ShirazKitchen/?hl=en", ("instagram", "shirazkitchen")),
        ("instagram.com/lmlawcpa.persian", ("instagram", "lmlawcpa.persian")),
        ("https://www.instagram.com/p/Cx123/", None),
        ("https://www.facebook.com/470792293411166", ("facebook", "470792293411166")),
        ("https://m.facebook.com/ShirazKitchenTO/", ("facebook", "shirazkitchento")),
        ("https://www.facebook.com/profile.php?id=100064", ("facebook", "100064")),
        ("https://www.facebook.com/pages/Shiraz/12345", ("facebook", "12345")),
        ("https://www.facebook.com/sharer/sharer.php?u=x", None),
        ("https://t.me/tehran_market", ("telegram", "tehran_market")),
        ("https://t.me/joinchat/AAAA", None),
        ("https://www.sinapersiangrill.com/menu", None),
    ]
    got = column(spark, [u for u, _ in table], links.social_link("v"))
    assert [(r.kind, r.value) if r else None for r in got] == [e for _, e in table]


def test_websites(spark):
    table = [
        ("http://yp.ca/bus/101343761", None),
        ("https://www.homestars.com/companies/1", None),
        ("http://www.monasadatshirazi.royallepage.ca/", "monasadatshirazi.royallepage.ca"),
        ("https://WWW.Ghazale.ca", "ghazale.ca"),
        ("https://www.gelbeseiten.de/gsbiz/1a98d1c3", None),
        ("https://www.example-directory.com/biz/1a98d1c3-97e6",
         "example-directory.com/biz/1a98d1c3-97e6"),
        ("https://ghazale.ca/menu", "ghazale.ca"),
        ("https://ghazale.ca/fa/", "ghazale.ca"),
        ("ftp://ghazale.ca/", None), ("nodots", None),
    ]
    got = column(spark, [u for u, _ in table], links.website_link("v"))
    assert [r.value if r else None for r in got] == [e for _, e in table]
    kinds = column(spark, ["https://www.facebook.com/tehranchisepehr",
                           "https://persiandesignerrugs.ca/"], links.classify_url("v"))
    assert [k.kind for k in kinds] == ["facebook", "website"]


def test_phones(spark):
    table = [("(647) 350-5581", "CA", "+16473505581"), ("040 1234567", "DE", "+49401234567"),
             ("not a phone", "CA", None), ("+1 416-555-0101", "DE", "+14165550101"),
             ("1-416-555-0101", "US", "+14165550101"), ("+41 44 555 01 20", "CA", "+41445550120"),
             ("+98 21 5550 1234", "US", "+982155501234"), ("+999", "US", None), ("0044 20 7946 0000", "DE",
                                                        "+442079460000")]
    got = column(spark, [(n, c) for n, c, _ in table], links.phone_e164("v", "c"),
                 "v string, c string")
    assert got == [e for _, _, e in table]


def test_addresses(spark):
    table = [  # address, without units, postal code
        ("5 Elm Row", "5 Elm Row", None),
        ("5 Elm Row, Suite 9, Oslo", "5 Elm Row, Oslo", None),
        ("5 Elm Row apt. 12B, Oslo", "5 Elm Row, Oslo", None),
        ("5 Elm Row STE-40", "5 Elm Row", None),
        ("5 Suitely Row", "5 Suitely Row", None),
        ("5 Elm Row # 7, Oslo", "5 Elm Row, Oslo", None),
        ("5 Elm Row #7 rear", "5 Elm Row rear", None),
        ("7 - 44 Birch Way", "44 Birch Way", None),
        ("7-44 Birch Way", "44 Birch Way", None),
        ("7- 44 Birch Way", "44 Birch Way", None),
        ("Bo-Kaap Way", "Bo-Kaap Way", None),
        ("44 Birch Way, C, 12, 12c, Reno", "44 Birch Way, Reno", None),
        ("44 Birch Way, Kelowna V1Y 2B3", "44 Birch Way, Kelowna V1Y 2B3", "V1Y 2B3"),
        ("44 Birch Way, Kelowna, v1y2b3", "44 Birch Way, Kelowna, v1y2b3", "v1y2b3"),
        ("44 Birch Way, V1Y Kelowna 2B3", "44 Birch Way, V1Y Kelowna 2B3", None),
        ("10250 Birch Way, Reno, NV 89501", "10250 Birch Way, Reno, NV 89501", "89501"),
        ("10250 Birch Way, Reno, NV", "10250 Birch Way, Reno, NV", "10250"),
        ("10250 Birch Way 4, Reno", "10250 Birch Way 4, Reno", None),
        ("44 Birch Way, 895012", "44 Birch Way", None),
        ("", "", None),
    ]
    assert column(spark, [a for a, _, _ in table], address.clean_address("v")) == [
        c for _, c, _ in table]
    assert column(spark, [a for a, _, _ in table], address.postal_code("v")) == [
        p for _, _, p in table]


def test_names_and_similarity(spark):
    assert column(spark, ["The Isfahan Kitchen Inc."], tx.normalize_name("v")) == ["isfahan"]
    pairs = [("Shiraz Restaurant", "SHIRAZ"), ("Shiraz Grill", "Tehran Grill"),
             ("tehran market hall", "market tehran hall"), ("shirazz", "shiraz"), ("", "x")]
    ratio = similarity.token_set_ratio(tx.normalize_name("a"), tx.normalize_name("b"))
    got = column(spark, pairs, ratio, "a string, b string")
    assert got[0] == 100 and got[1] < 80 and got[2] == 100 and got[4] == 0
    assert got[3] == pytest.approx(100 - 100 / 13)


def plain_ratio(a, b):
    """The same definition with sets and a quadratic table, for comparison."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, ra, rb = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not ra or not rb):
        return 100.0
    table = [[0] * (len(rb) + 1) for _ in range(len(ra) + 1)]
    for i, p in enumerate(ra):
        for j, q in enumerate(rb):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1],
                                                                     table[i + 1][j])
    n = len(" ".join(both))
    sep = 1 if n else 0
    ta, tb = n + sep + len(ra), n + sep + len(rb)
    dist = len(ra) + len(rb) - 2 * table[-1][-1]
    best = 100 - 100 * dist / (ta + tb)
    if n:
        best = max(best, 100 - 100 * (sep + len(ra)) / (n + ta),
                   100 - 100 * (sep + len(rb)) / (n + tb))
    return best


words = st.lists(st.sampled_from(["shiraz", "shirazz", "hot", "ring", "bolt", "rod", "rode"]),
                 max_size=4).map(lambda w: " ".join(dict.fromkeys(w)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=10, max_size=30))
def test_similarity_equals_the_definition(spark, pairs):
    got = column(spark, pairs, similarity.token_set_ratio("a", "b"), "a string, b string")
    assert got == pytest.approx([plain_ratio(a, b) for a, b in pairs])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcİıي‌ xÉ🙂ΣßǅK", max_size=20), min_size=5, max_size=20))
def test_fold_keeps_length(spark, texts):
    got = column(spark, texts, F.length(tx.fold("v")))
    assert got == [len(t) for t in texts]


def test_categories(spark):
    taxonomy, basic, tags = categories.default_maps()
    rows = [
        (["food_and_drink", "restaurant", "middle_eastern_restaurant", "persian_restaurant"],
         "restaurant", "restaurant"),
        (["health_care", "dental_clinic", "general_dentistry"], "dental_clinic",
         "doctor/dentist"),
        (["services_and_business", "legal_service", "immigration_law"], "attorney_or_law_firm",
         "lawyer"),
        (["shopping", "food_and_beverage_store", "bakery"], "food_and_beverage_store", "bakery"),
        (["shopping", "vehicle_dealer", "auto_dealer"], "auto_dealer", "other"),
        ([], "real_estate_service", "real_estate"), (None, None, "other"),
    ]
    got = column(spark, [(h, b) for h, b, _ in rows],
                 categories.map_hierarchy("h", "b", taxonomy, basic), "h array<string>, b string")
    assert got == [e for _, _, e in rows]
    table = [({"amenity": "restaurant", "cuisine": "persian"}, "restaurant"),
             ({"amenity": "dentist"}, "doctor/dentist"), ({"healthcare": "doctor"}, "doctor"),
             ({"shop": "bakery"}, "bakery"), ({"shop": "hairdresser;beauty"}, "beauty"),
             ({"tourism": "hotel"}, "other")]
    got = column(spark, [(t,) for t, _ in table], categories.map_tags("t", tags),
                 "t map<string,string>")
    assert got == [e for _, e in table]
    codes = [("722513", "restaurant"), ("621210", "doctor/dentist"), ("621111", "doctor"),
             ("541110", "lawyer"), ("813110", "community"), ("236118", "other"), (None, "other")]
    assert column(spark, [c for c, _ in codes],
                  categories.map_prefix("v", fv.NAICS_CATEGORY)) == [e for _, e in codes]
    naf = [("56.10A", "restaurant"), ("86.23Z", "doctor/dentist"), ("86.21Z", "doctor"),
           ("01.11Z", "other")]
    assert column(spark, [c for c, _ in naf], categories.map_prefix(
        "v", fv.NAF_CATEGORY, longest=True)) == [e for _, e in naf]


def test_distance_and_boxes(spark):
    got = column(spark, [(43.70, -79.40, 43.7022, -79.4005), (43.70, -79.40, 43.80, -79.40)],
                 geo.distance_m("a", "b", "c", "d"), "a double, b double, c double, d double")
    assert 240 < got[0] < 255 and 11000 < got[1] < 11200
    box = column(spark, [(48.85, 2.35)], geo.metro_box("a", "b", F.lit(None), F.lit(None),
                                                       F.lit(None), F.lit(None)),
                 "a double, b double")[0]
    assert box.north - box.south == pytest.approx(0.36)
    assert box.east - box.west == pytest.approx(0.36 / 0.658, abs=2e-3)
    huge = column(spark, [(48.0, 2.0, 40.0, 56.0, -10.0, 14.0)],
                  geo.metro_box("a", "b", "s", "n", "w", "e"),
                  "a double, b double, s double, n double, w double, e double")[0]
    assert huge.north - huge.south == pytest.approx(1.2)


def test_wilson_and_slug(spark):
    lo, hi = scoring.wilson("k", "n")
    assert column(spark, [(1, 1), (0, 0)], F.array(F.round(lo, 3), F.round(hi, 3)),
                  "k int, n int") == [[0.207, 1.0], [0.0, 0.0]]
    assert column(spark, ["São Paulo", "東京", "Köln-Süd"], tx.slugify("v")) == [
        "sao-paulo", "city", "koln-sud"]
    assert column(spark, ["see [[Iran|Iranian]] ''tea'' {{price|$$}}  now"],
                  tx.wiki_plain("v")) == ["see Iranian tea now"]


def test_map_urls(spark):
    row = column(spark, [("Shiraz & Co", "1 Yonge St", 43.7, -79.4)],
                 links.map_urls("n", "a", "y", "x"),
                 "n string, a string, y double, x double")[0]
    assert row.google_maps.endswith("query=Shiraz%20%26%20Co%2C%201%20Yonge%20St")
    assert row.apple_maps.endswith("?q=Shiraz%20%26%20Co&ll=43.7,-79.4")
    assert row.openstreetmap.endswith("?mlat=43.7&mlon=-79.4#map=18/43.7/-79.4")


def test_a_house_number_is_no_canadian_postal_code(spark):
    from vouch.operators.filters import geocode_join

    rows = spark.createDataFrame([
        (1, "10002 MAIN ST, TORONTO", "CA"), (2, "1 MAIN ST, CA 90035", "US"),
        (3, "10003 MAIN ST, TORONTO, M2M 3S9", "CA")], "k int, address string, country_code string")
    known = spark.createDataFrame([
        ("10002 MAIN ST, TORONTO | ca", None, None), ("10002 | ca", 9.0, 9.0),
        ("90035 | us", 2.0, 2.0), ("M2M 3S9 | ca", 3.0, 3.0)],
        "query string, lat double, lng double")
    got = {r.k: (r.lat, r.geocoded) for r in geocode_join(rows, known).collect()}
    assert got == {1: (None, True), 2: (2.0, True), 3: (3.0, True)}


def test_nfkc_sends_every_character_that_can_change(spark):
    import unicodedata

    texts = [chr(c) for c in [*range(0x1, 0xD800), *range(0xE000, 0x11000), 0x1F600, 0x2F800]]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select("v", F.col("v").rlike(tx._unstable()).alias("sent")).collect()
    for r in got:
        if unicodedata.normalize("NFKC", r.v) != r.v or unicodedata.combining(r.v):
            assert r.sent, hex(ord(r.v))
    sent = {r.v for r in got if r.sent}
    assert not sent & set("az AZ09~\n\t\r" + "éßüپچژگیکا؟")


def test_letters_are_counted_one_by_one(spark):
    got = spark.createDataFrame([("ab \U00010400 پچ1، x",), ("",), ("12",)], "v string").select(
        *tx.letter_counts("v")).collect()
    assert [tuple(r) for r in got] == [(2, 2 / 6), (0, 0.0), (0, 0.0)]


def test_whole_words_of_any_first_letter(spark):
    pattern = tx.whole_word(["-shop", "c++", "[x]", "^a", "b-c", " d"])
    texts = ["a shop", "in c++ now", "[x]", "^a", "b c", "d", "workshop", "xd"]
    assert column(spark, texts, F.col("v").rlike(pattern)) == [True] * 6 + [False] * 2
