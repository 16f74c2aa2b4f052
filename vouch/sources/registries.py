"""Government registries. Personal names are never used and coordinates stay private."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import categories
from vouch.functions import signals as sg
from vouch.operators.filters import geocode_join
from vouch.operators.ranking import first_by
from vouch.sources.listing import detect, filled, make, number, source, text_field, texts


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; every column stays text. A byte-order mark is dropped.

    Files are split between tasks. ``multi_line`` is for files known to have line breaks inside
    quotes; each of them is then read by one task."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json_array_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array written with one record per line: splittable, unlike a multi-line array."""
    line = F.regexp_replace(F.trim(F.regexp_replace("value", "^﻿", "")), r"^[\[,\s]+", "")
    line = F.regexp_replace(line, r"[\],\s]+$", "")
    df = spark.read.text(path).select(line.alias("l")).where(F.col("l").startswith("{"))
    return df.select(F.from_json("l", schema).alias("r")).select("r.*")


def _private(df: DataFrame, keep, *, source_id: str, external_id: Column, name: Column,
             url: Column, lat: Column | None = None, lng: Column | None = None, **rest):
    fields = rest.pop("texts", None)
    if fields is None:
        fields = texts(text_field("name", name, url))
    return make(df, keep, source_id=F.lit(source_id), external_id=external_id, name=name,
                url=url, lat=lat, lng=lng, texts=fields, private_location=F.lit(True), **rest)


@source("gov:la_business")
def la_listings(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The trade name, or the legal name of a company; a person's name is never taken."""
    suffix = r"(?i)\b(?:" + "|".join(fv.COMPANY_SUFFIXES) + r")\b\.?"
    legal = filled(F.col("business_name"))
    name = F.coalesce(filled(F.col("dba_name")), F.when(legal.rlike(suffix), legal))
    df = rows.withColumn("_name", name).where(F.col("_name").isNotNull())
    lat, lng = (number(F.col(f"location_1.{c}")) for c in ("latitude", "longitude"))
    placed = (lat != 0) & (lng != 0)
    return _private(
        df, keep, source_id="gov:la_business", external_id=F.col("location_account"),
        name=F.col("_name"), url=F.lit(fv.LA_PAGE),
        lat=F.when(F.coalesce(placed, F.lit(True)), lat),
        lng=F.when(F.coalesce(placed, F.lit(True)), lng),
        category=categories.map_prefix("naics", fv.NAICS_CATEGORY),
        raw=F.to_json(F.struct(F.col("_name").alias("name"), "naics")))


@source("gov:vancouver_business")
def vancouver_listings(rows: DataFrame, years: tuple[str, ...] | None = None,
                       keep: list[str] | None = None) -> DataFrame:
    """Issued licences of the given folder years; the newest year per name and address.
    A legal name in parentheses is a person's and is not used."""
    legal = filled(F.col("businessname"))
    name = F.coalesce(filled(F.col("businesstradename")),
                      F.when(~legal.startswith("("), legal))
    df = rows.where(F.coalesce(F.col("status") == "Issued", F.lit(True)))
    if years is not None:
        df = df.where(F.col("folderyear").isin(*years))
    df = df.withColumns({"_name": name, "_house": F.coalesce("house", F.lit("")),
                         "_street": F.lower(F.coalesce("street", F.lit("")))})
    df = df.where(F.col("_name").isNotNull()).withColumn("_key", F.lower("_name"))
    keys = ["_key", "_house", "_street"]
    # newest year first; full order so that equal years are decided the same way every time
    year = F.translate("folderyear", "0123456789", "9876543210")
    others = [c for c in ("businesstype", "_name", *(keep or [])) if c in df.columns]
    df = first_by(df, keys, [year.alias("y"), *others])
    return _private(
        df, keep, source_id="gov:vancouver_business",
        external_id=F.concat_ws("|", "_key", "_house", "_street"), name=F.col("_name"),
        url=F.lit(fv.VANCOUVER_PAGE), lat=F.col("geo_point_2d.lat"),
        lng=F.col("geo_point_2d.lon"),
        category=categories.map_needles("businesstype", fv.VANCOUVER_CATEGORY),
        raw=F.to_json(F.struct(F.col("_name").alias("name"), F.col("businesstype").alias("type"),
                               F.col("folderyear").alias("year"))))


def hinted(rows: DataFrame, name: Column, lexicon: sg.Lexicon) -> DataFrame:
    """Rows whose name passes the coarse hint test, before any detection or geocoding."""
    return rows.where(sg.hint_filter(name, lexicon.hint_terms()))


@source("gov:toronto_business")
def toronto_listings(rows: DataFrame, gazetteer: DataFrame, lexicon: sg.Lexicon,
                     keep: list[str] | None = None) -> DataFrame:
    """Running licences whose name shows evidence, located through the gazetteer."""
    df = rows.withColumn("_name", filled(F.col("Operating Name")))
    df = df.where(F.col("_name").isNotNull()
                  & (F.coalesce("Cancel Date", F.lit("")) == ""))
    df = hinted(df, F.col("_name"), lexicon)
    parts = [F.nullif(F.col(f"Licence Address Line {i}"), F.lit("")) for i in (1, 2, 3)]
    df = df.withColumns({"address": F.concat_ws(", ", *parts), "country_code": F.lit("CA")})
    phone = filled(F.col("Business Phone"))
    out = _private(
        geocode_join(df, gazetteer), keep, source_id="gov:toronto_business",
        external_id=F.coalesce(F.nullif(F.col("`Licence No.`"), F.lit("")),
                               F.concat_ws("|", "_name", "address")),
        name=F.col("_name"), url=F.lit(fv.TORONTO_PAGE), lat=F.col("lat"), lng=F.col("lng"),
        category=categories.map_needles("Category", fv.TORONTO_CATEGORY),
        phones=F.array_compact(F.array(phone)),
        raw=F.to_json(F.struct(F.col("_name").alias("name"), F.col("Category").alias("category"))))
    return _with_evidence(out, lexicon)


def _with_evidence(listings: DataFrame, lexicon: sg.Lexicon) -> DataFrame:
    """Only listings whose own texts give positive evidence. Registry rows carry no signals
    of their own, so the detected ones are dropped again; the index detects per country."""
    return detect(listings, lexicon).withColumn("signals", F.array().cast(sg.SIGNALS))


@dataclass(frozen=True)
class Registry:
    """Column map of a nonprofit registry."""

    source_id: str
    country: str
    number: str
    names: tuple[str, ...]
    address: tuple[str, ...]
    region: str | None
    page: str
    page_takes_number: bool = False
    ntee: str | None = None
    website: str | None = None
    #: the last two address parts are separated by a blank, the post code cut to 5 characters
    us_style: bool = False
    #: every name is a text of its own (else the first filled one is the name)
    all_names: bool = False


IRS = Registry("gov:irs_eo_bmf", "US", "EIN", ("NAME",), ("STREET", "CITY", "STATE", "ZIP"),
               "STATE", fv.IRS_PAGE, ntee="NTEE_CD", us_style=True)
CRA = Registry("gov:cra_charities", "CA", "BN", ("Account Name", "Legal Name"),
               ("Address Line 1", "City", "Province", "Postal Code"), "Province", fv.CRA_PAGE)
ACNC = Registry("gov:acnc_charities", "AU", "ABN",
                ("Charity_Legal_Name", "Other_Organisation_Names"),
                ("Address_Line_1", "Town_City", "State", "Postcode"), "State", fv.ACNC_PAGE,
                page_takes_number=True, website="Charity_Website", all_names=True)
UK = Registry("gov:uk_charities", "GB", "registered_charity_number", ("charity_name",),
              (*[f"charity_contact_address{i}" for i in range(1, 6)],
               "charity_contact_postcode"), None, fv.UK_CHARITY_PAGE, page_takes_number=True,
              website="charity_contact_web")


def registered_main_charities(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("charity_registration_status") == "Registered")
                      & (F.col("linked_charity_number") == 0))


def nonprofit_listings(rows: DataFrame, registry: Registry, gazetteer: DataFrame,
                       cities: DataFrame, lexicon: sg.Lexicon,
                       keep: list[str] | None = None) -> DataFrame:
    """Registry rows with evidence in the name that lie in the box of a city which reads the
    row's region: hint, detector, gazetteer, box, in this order of cost."""
    r = registry
    names = [filled(F.col(f"`{n}`")) for n in r.names]
    tested = F.concat_ws(" | ", *names) if r.all_names else F.coalesce(*names)
    df = rows.withColumns({"_name": names[0] if r.all_names else tested, "_tested": tested})
    if r is UK:
        df = registered_main_charities(df)
    readers = cities.where(F.col("country_code") == r.country)
    if r.region is not None:
        regions = readers.select(F.explode("regions").alias("_region")).distinct()
        df = df.withColumn("_region", F.col(f"`{r.region}`")).join(regions, "_region", "left_semi")
    df = hinted(df.where(F.col("_name").isNotNull()), F.col("_tested"), lexicon)
    parts = [F.col(f"`{a}`") for a in r.address]
    if r.us_style:
        blank = [F.coalesce(p, F.lit("")) for p in parts]
        address = F.concat(blank[0], F.lit(", "), blank[1], F.lit(", "), blank[2], F.lit(" "),
                           F.substring(blank[3], 1, 5))
    else:
        address = F.concat_ws(", ", *[filled(p) for p in parts])
    df = df.withColumns({"address": address, "country_code": F.lit(r.country)})
    number_ = F.col(f"`{r.number}`").cast("string")
    url = F.concat(F.lit(r.page), number_) if r.page_takes_number else F.lit(r.page)
    web = filled(F.col(f"`{r.website}`")) if r.website else F.lit(None).cast("string")
    web = F.when(web.startswith("http"), web).otherwise(F.concat(F.lit("https://"), web))
    fields = [text_field("name", n, url) for n in (names if r.all_names else [F.col("_name")])]
    out = _private(
        geocode_join(df, gazetteer), [*(keep or []), *(["_region"] if r.region else [])],
        source_id=r.source_id, external_id=number_, name=F.col("_name"), url=url,
        lat=F.col("lat"), lng=F.col("lng"),
        category=categories.nonprofit_category("_name", f"`{r.ntee}`" if r.ntee else None),
        urls=F.array_compact(F.array(web)), texts=texts(*fields),
        raw=F.to_json(F.struct(number_.alias("number"), F.col("_name").alias("name"))))
    boxed = _in_reading_city(_with_evidence(out, lexicon), readers, r.region is not None)
    return boxed.drop("_region")


def _in_reading_city(listings: DataFrame, cities: DataFrame, by_region: bool) -> DataFrame:
    from vouch.operators.spatial import city_box_join

    boxes = cities.select("west", "south", "east", "north",
                          *([F.col("regions").alias("_regions")] if by_region else []))
    inside = city_box_join(listings, boxes)
    if by_region:
        inside = inside.where(F.array_contains("_regions", F.col("_region")))
    return inside.select(*listings.columns).dropDuplicates(["source_id", "external_id"])


@source("gov:fr_sirene")
def fr_company_listings(companies: DataFrame, cities: DataFrame, lexicon: sg.Lexicon,
                        keep: list[str] | None = None) -> DataFrame:
    """Open establishments, in a French city box, of public companies whose name shows
    evidence. Sole traders are skipped: their company name is a person's."""
    df = companies.where(
        ~F.coalesce(F.col("nature_juridique").startswith("1"), F.lit(False))
        & F.coalesce(F.col("statut_diffusion") == "O", F.lit(True)))
    df = df.withColumn("_name", filled(F.col("nom_complet"))).where(F.col("_name").isNotNull())
    places = F.coalesce(F.when(F.size("matching_etablissements") > 0,
                               F.col("matching_etablissements")),
                        F.array("siege"))
    df = df.select(*(keep or []), "siren", "_name", F.col("activite_principale").alias("_naf"),
                   F.explode(places).alias("p"))
    df = df.where((F.coalesce("p.siret", F.lit("")) != "")
                  & (F.col("p.etat_administratif") == "A"))
    df = df.withColumns({"_siret": F.col("p.siret"), "_lat": number(F.col("p.latitude")),
                         "_lng": number(F.col("p.longitude"))})
    df = first_by(df, ["_siret"], ["siren", "_name"])
    naf = F.coalesce(F.nullif("p.activite_principale", F.lit("")), "_naf")
    out = _private(
        df, keep, source_id="gov:fr_sirene", external_id=F.col("_siret"), name=F.col("_name"),
        url=F.concat(F.lit(fv.COMPANY_FR_PAGE), F.col("siren")), lat=F.col("_lat"),
        lng=F.col("_lng"),
        category=categories.map_prefix(naf, fv.NAF_CATEGORY, longest=True),
        raw=F.to_json(F.struct("siren", F.col("_siret").alias("siret"),
                               F.col("_name").alias("name"), naf.alias("naf"))))
    readers = cities.where((F.col("country_code") == "FR") & (F.size("regions") > 0))
    return _with_evidence(_in_reading_city(out, readers, False), lexicon)


