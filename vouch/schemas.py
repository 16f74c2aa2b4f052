"""Explicit schemas shared by readers, operators and streams."""

from pyspark.sql import types as T

S, D, B, L, I, TS = (T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(),
                     T.IntegerType(), T.TimestampType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT = struct(kind=S, text=S, url=S)
SIGNAL = struct(signal=S, weight=D, snippet=S, url=S)
LINK = struct(kind=S, value=S, url=S)

LISTING = struct(
    source_id=S, external_id=S, name=S, url=S, lat=D, lng=D, address=S, category=S,
    phones=T.ArrayType(S), urls=T.ArrayType(S), texts=T.ArrayType(TEXT),
    signals=T.ArrayType(SIGNAL), raw=S, private_location=B,
)

CITY = struct(
    city_id=L, slug=S, country_code=S, name_en=S, west=D, south=D, east=D, north=D,
    regions=T.ArrayType(S), wikivoyage=T.ArrayType(S), enabled=B,
)
COUNTRY = struct(code=S, name_en=S, name_fa=S, min_display_score=D, enabled=B)
SOURCE = struct(id=S, name_en=S, name_fa=S, kind=S, status=S, phase=I, account_required=B,
                monthly_cap=I, enabled=B)
CATEGORY = struct(slug=S, parent_slug=S, name_en=S, name_fa=S, position=I)
REGISTRY = struct(id=S, name_en=S, url=S, regions=T.ArrayType(S), categories=T.ArrayType(S))

BUSINESS = struct(
    business_id=S, city_id=L, name_fa=S, name_latin=S, address=S, lat=D, lng=D, phone_e164=S,
    website=S, score=D, label=S, status=S, first_seen=TS, last_verified_at=TS,
)
SOURCE_RECORD = struct(source_id=S, external_id=S, business_id=S, url=S, raw=S, fetched_at=TS)
EVIDENCE = struct(source_id=S, external_id=S, business_id=S, signal=S, weight=D, snippet=S,
                  url=S)
BUSINESS_LINK = struct(business_id=S, kind=S, value=S, url=S)
BUSINESS_CATEGORY = struct(business_id=S, slug=S)
BLOCKED = struct(kind=S, value=S)

PLACES = struct(
    id=S,
    names=struct(primary=S, common=T.MapType(S, S)),
    taxonomy=struct(primary=S, hierarchy=T.ArrayType(S)),
    basic_category=S, websites=T.ArrayType(S), socials=T.ArrayType(S), phones=T.ArrayType(S),
    addresses=T.ArrayType(struct(freeform=S, locality=S, region=S)),
    sources=T.ArrayType(struct(dataset=S)), operating_status=S,
    bbox=struct(xmin=D, xmax=D, ymin=D, ymax=D),
)
OSM_ELEMENT = struct(type=S, id=L, lat=D, lon=D, center=struct(lat=D, lon=D),
                     tags=T.MapType(S, S))
LA_LICENCE = struct(location_account=S, business_name=S, dba_name=S, naics=S,
                    location_1=struct(latitude=S, longitude=S))
VANCOUVER_LICENCE = struct(
    businesstradename=S, businessname=S, businesstype=S, status=S, folderyear=S, house=S,
    street=S, geo_point_2d=struct(lat=D, lon=D), licencenumber=S)
UK_CHARITY = struct(
    registered_charity_number=L, linked_charity_number=L, charity_name=S,
    charity_registration_status=S, charity_contact_address1=S, charity_contact_address2=S,
    charity_contact_address3=S, charity_contact_address4=S, charity_contact_address5=S,
    charity_contact_postcode=S, charity_contact_web=S)
_SITE = struct(siret=S, activite_principale=S, latitude=S, longitude=S, etat_administratif=S,
               adresse=S)
FR_COMPANY = struct(
    siren=S, nom_complet=S, nature_juridique=S, statut_diffusion=S, activite_principale=S,
    siege=_SITE, matching_etablissements=T.ArrayType(_SITE))
WIKI_PAGE = struct(title=S, wikitext=S)
_V = struct(value=S)
WIKIDATA_BINDING = struct(item=_V, enLabel=_V, enDesc=_V, faLabel=_V, coord=_V, website=_V,
                          instagram=_V, facebook=_V, types=_V)
