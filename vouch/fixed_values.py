"""Constants, word lists and lookup tables that results depend on.

Everything here is data, stated in its natural order. All of it can be replaced by the
caller: lexicons, weights, category maps and thresholds are arguments of the operators.
"""

# ---- fixed values: signal weights -------------------------------------------------
SIGNAL_WEIGHTS = {
    "explicit_keyword": 0.6,
    "persian_product_term": 0.2,
    "osm_cuisine_tag": 0.7,
    "osm_language_fa": 0.7,
    "overture_persian_category": 0.7,
    "google_type_persian": 0.7,
    "persian_script_name": 0.5,
    "persian_script_text": 0.4,
    "website_persian_content": 0.5,
    "telegram_persian_content": 0.5,
    "iranian_place_name": 0.3,
    "iranian_food_terms": 0.4,
    "persian_personal_name": 0.2,
    "listed_in_iranian_directory": 0.6,
    "linked_from_iranian_source": 0.3,
    "nowruz_yalda_mentions": 0.3,
    "user_submission_verified": 0.8,
    "registry_language_farsi": 0.8,
    "schemaorg_serves_persian": 0.7,
    "cc_persian_language_site": 0.4,
    "wikidata_iran_related": 0.5,
    "negative_keyword": 0.3,
}
NEGATIVE_SIGNAL = "negative_keyword"
AMBIGUOUS_PLACE_WEIGHT = 0.15

# ---- fixed values: thresholds -----------------------------------------------------
LEVEL_CUTS = {"high": 0.75, "medium": 0.45, "low": 0.25}
MIN_DISPLAY_SCORE = 0.25
MIN_PAGE_CHECK_SCORE = 0.15
RECHECK_DAYS = 30
REINDEX_AFTER_DAYS = 7
HIDE_AFTER_REPORTS = 3
DAILY_SUBMISSION_CAP = 5
DAILY_CLAIM_CAP = 5
DAILY_NEW_CITY_CAP = 200
PRECISION_GOAL = 0.90
LABELS_PER_LEVEL = 100
MAX_MARKERS = 1000
MAX_SUGGESTIONS = 8
MAX_RECENT_JOBS = 50
SHARED_LINK_LIMIT = 2
NEARBY_METERS = 150.0
SAME_LINK_METERS = 1000.0
NAME_SIMILARITY_CUT = 80.0
EARTH_RADIUS_METERS = 6371008.8
SNIPPET_CONTEXT = 60
SNIPPET_MAX = 200
SHORT_SCRIPT_TEXT = 15
PAGE_MIN_LETTERS = 100
PAGE_MIN_RATIO = 0.3
CHANNEL_MIN_LETTERS = 12
SOCIAL_KINDS = ("facebook", "instagram", "telegram")

# ---- fixed values: character folding and script classes ---------------------------
FOLD_FROM = "يكإأ\u200cİı"
FOLD_TO = "یکاا ii"
ARABIC_BLOCK = "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff"
PERSIAN_LETTERS = "پچژگ"
PERSIAN_FORMS = "یک\u200c"
ARABIC_FORMS = "يكةى"
PASHTO_LETTERS = "ټډړږښګڼېۍځڅ"
URDU_LETTERS = "ٹڈڑںےھۓہۂۃ"
SORANI_LETTERS = "ڵڕۆێەڤ"

# ---- fixed values: word lists of the default lexicon, one term per line ------------
LEXICON_FILES = {
    "explicit": "keywords_explicit.txt",
    "product_terms": "product_terms.txt",
    "product_adjectives": "product_adjectives.txt",
    "places": "iranian_places.txt",
    "places_ambiguous": "iranian_places_ambiguous.txt",
    "place_adjectives": "iranian_place_adjectives.txt",
    "foods": "persian_foods.txt",
    "occasions": "occasions.txt",
    "negative": "negative_keywords.txt",
    "arabic_markers": "arabic_markers.txt",
    "surname_suffixes": "surname_suffixes.txt",
}
DEFAULT_LEXICON = {
    "explicit": """
persian
iranian
farsi
persisch
persische
persischer
persisches
iranisch
iranische
iranischer
iranisches
farsi-speaking
persan
persane
iranien
iranienne
we speak farsi
farsi spoken
persian speaking
persian-speaking
farsi speaking
iranischen
iranischem
persischen
persischem
iraniens
iraniennes
persans
persanes
iraniano
iraniana
persa
ایرانی
ایران
فارسی
پارسی
فارسی‌زبان
فارسی زبان
persisk
persiska
persiskt
iransk
iranska
iranskt
perzisch
perzische
iraans
iraanse
iranli
farsça
iran mutfaği
iran restoranı
إيرانية
""",
    "product_terms": """
rug
rugs
carpet
carpets
kilim
kilims
teppich
teppiche
tapis
cat
cats
kitten
kittens
cattery
blinds
gulf
lime
limes
cucumber
cucumbers
melon
melons
""",
    "product_adjectives": """
persian
persisch
persische
persischer
persisches
persan
persane
oriental
persia
persischen
persischem
persans
persanes
persa
""",
    "places": """
tehran
teheran
shiraz
isfahan
esfahan
tabriz
mashhad
kerman
yazd
rasht
qazvin
hamadan
persepolis
pasargad
pasargadae
pars
parsian
persia
zagros
alborz
damavand
shemiran
tajrish
تهران
شیراز
اصفهان
تبریز
مشهد
کرمان
یزد
رشت
پارس
پرسپولیس
تخت جمشید
البرز
دماوند
""",
    "places_ambiguous": """
caspian
khazar
kish
parsi
iran
""",
    "place_adjectives": """
tehrani
shirazi
esfahani
isfahani
tabrizi
mashhadi
kermani
yazdi
rashti
qazvini
hamadani
""",
    "foods": """
koobideh
kubideh
koubideh
koobide
kabab koobideh
ghormeh
ghormeh sabzi
gormeh sabzi
fesenjan
fesenjoon
tahdig
tah dig
barbari
sangak
taftoon
doogh
dough drink
joojeh
jujeh
joojeh kabab
chelo kabab
zereshk polo
baghali polo
sabzi polo
ash reshteh
aash reshteh
kashk bademjan
mirza ghasemi
sholeh zard
faloodeh
paloodeh
gaz nougat
noon khamei
zoolbia
bamieh
bastani sonnati
sohan asali
کوبیده
قرمه سبزی
قرمه‌سبزی
فسنجان
ته‌دیگ
ته دیگ
نان بربری
بربری
سنگک
دوغ
جوجه کباب
چلوکباب
چلو کباب
زرشک پلو
باقالی پلو
آش رشته
کشک بادمجان
میرزاقاسمی
شله زرد
بستنی سنتی
فالوده
سوهان
""",
    "occasions": """
nowruz
norooz
nowrouz
noruz
nourooz
yalda
shab-e yalda
chaharshanbe suri
sizdah bedar
نوروز
یلدا
شب یلدا
چهارشنبه سوری
سیزده بدر
""",
    "negative": """
afghan
afghani
afghanistan
turkish
lebanese
syrian
iraqi
arabic
arab
pakistani
indian
""",
    "arabic_markers": """
مطعم
مطاعم
حلويات
للاستشارات
""",
    "surname_suffixes": """
zadeh
pour
nejad
nezhad
fard
""",
}
HINT_LISTS = ("explicit", "places", "places_ambiguous", "foods", "occasions")
COUNTRY_EXCLUSIONS = {"TR": ("persan", "persane", "persans", "persanes")}

# ---- fixed values: names ----------------------------------------------------------
GENERIC_NAME_WORDS = (
    "the", "restaurant", "restaurants", "cafe", "café", "kitchen", "grill", "bar", "market",
    "supermarket", "bakery", "inc", "ltd", "llc", "co", "corp", "corporation", "company",
    "gmbh", "ug", "e.k", "and", "&", "of", "dds", "md", "pc", "رستوران", "کافه", "فروشگاه",
)
COMPANY_SUFFIXES = (
    "INC", "INCORPORATED", "LLC", r"L\.L\.C", "CORP", "CORPORATION", "CO", "COMPANY", "LTD",
    "LP", "LLP", "PC", "APC", "GROUP",
)

# ---- fixed values: links ----------------------------------------------------------
INSTAGRAM_HOSTS = ("instagram.com", "instagr.am")
INSTAGRAM_RESERVED = (
    "p", "reel", "reels", "explore", "stories", "accounts", "tv", "about", "developer",
    "direct", "legal", "privacy", "web", "share",
)
FACEBOOK_HOSTS = ("facebook.com", "fb.com", "fb.me", "business.facebook.com")
FACEBOOK_RESERVED = (
    "sharer", "sharer.php", "share", "share.php", "groups", "events", "watch", "login",
    "login.php", "dialog", "plugins", "hashtag", "help", "policies", "privacy", "tr",
    "photo", "photo.php", "story.php", "permalink.php", "marketplace", "gaming",
)
TELEGRAM_HOSTS = ("t.me", "telegram.me", "telegram.dog")
TELEGRAM_RESERVED = ("s", "joinchat", "share", "addstickers", "proxy", "iv", "c")
INSTAGRAM_HANDLE = r"^[A-Za-z0-9._]{1,30}$"
FACEBOOK_HANDLE = r"^[A-Za-z0-9.\-]{2,100}$"
TELEGRAM_HANDLE = r"^[A-Za-z][A-Za-z0-9_]{3,31}$"
DEEP_SEGMENT_CHARS = 24
NON_BUSINESS_DOMAINS = """
facebook.com fb.com instagram.com t.me telegram.me twitter.com x.com youtube.com youtu.be
tiktok.com linkedin.com pinterest.com pinterest.ca linktr.ee yelp.com yelp.ca yp.ca
yellowpages.com yellowpages.ca homestars.com google.com goo.gl maps.app.goo.gl tripadvisor.com
tripadvisor.ca opentable.com ubereats.com doordash.com skipthedishes.com grubhub.com realtor.ca
gelbeseiten.de dasoertliche.de dastelefonbuch.de 11880.com meinestadt.de golocal.de cylex.de
jameda.de doctolib.de doctolib.fr pagesjaunes.ca pagesjaunes.fr 411.ca canpages.ca bbb.org
manta.com mapquest.com foursquare.com nextdoor.com houzz.com zocdoc.com healthgrades.com
ratemds.com vitals.com avvo.com justia.com findlaw.com lawyers.com realtor.com zillow.com
sites.google.com wa.me whatsapp.com wa.link bit.ly tinyurl.com calendly.com bazaarche.ca
iranianbusinesscenter.com gmail.com googlemail.com yahoo.com hotmail.com outlook.com icloud.com
""".split()

# ---- fixed values: category tables (prefix or needle -> category slug) -------------
NAICS_CATEGORY = (
    ("7225", "restaurant"), ("722", "restaurant"), ("311811", "bakery"), ("4452", "grocery"),
    ("4451", "grocery"), ("6212", "doctor/dentist"), ("6211", "doctor"), ("621", "doctor"),
    ("5411", "lawyer"), ("5312", "real_estate"), ("531", "real_estate"), ("8121", "beauty"),
    ("5412", "accounting"), ("54193", "translator"), ("611", "education"), ("813", "community"),
)
NAF_CATEGORY = (
    ("56.10", "restaurant"), ("56.30", "restaurant"), ("10.71", "bakery"), ("47.24", "bakery"),
    ("47.11", "grocery"), ("47.2", "grocery"), ("86.21", "doctor"), ("86.22", "doctor"),
    ("86.23", "doctor/dentist"), ("69.10", "lawyer"), ("68.31", "real_estate"),
    ("96.02", "beauty"), ("69.20", "accounting"), ("85", "education"), ("94", "community"),
    ("74.30", "translator"),
)
VANCOUVER_CATEGORY = (
    ("restaurant", "restaurant"), ("food establishment", "restaurant"),
    ("caterer", "restaurant"), ("grocery", "grocery"), ("retail dealer - food", "grocery"),
    ("health care", "doctor"), ("legal", "lawyer"), ("real estate", "real_estate"),
    ("beauty", "beauty"), ("financial services", "accounting"), ("school", "education"),
    ("instruction", "education"), ("association or society", "community"),
)
TORONTO_CATEGORY = (
    ("eating establishment", "restaurant"), ("take-out", "restaurant"),
    ("caterer", "restaurant"), ("bake", "bakery"), ("retail store (food)", "grocery"),
    ("grocer", "grocery"), ("barber", "beauty"), ("hair", "beauty"), ("body rub", "beauty"),
    ("holistic", "beauty"), ("school", "education"),
)
DIRECTORY_CATEGORY = (
    ("real estate", "real_estate"), ("realtor", "real_estate"), ("restaurant", "restaurant"),
    ("food", "restaurant"), ("cafe", "restaurant"), ("bakery", "bakery"),
    ("grocery", "grocery"), ("market", "grocery"), ("dentist", "doctor/dentist"),
    ("dental", "doctor/dentist"), ("doctor", "doctor"), ("medical", "doctor"),
    ("clinic", "doctor"), ("lawyer", "lawyer"), ("immigration", "lawyer"), ("legal", "lawyer"),
    ("beauty", "beauty"), ("salon", "beauty"), ("hair", "beauty"), ("account", "accounting"),
    ("tax", "accounting"), ("translat", "translator"), ("school", "education"),
    ("tutor", "education"), ("class", "education"),
)
ITEM_TYPE_CATEGORY = (
    ("restaurant", "restaurant"), ("café", "restaurant"), ("cafe", "restaurant"),
    ("bakery", "bakery"), ("grocery", "grocery"), ("supermarket", "grocery"),
    ("school", "education"), ("university", "education"), ("organization", "community"),
    ("association", "community"), ("cultural", "community"), ("mosque", "community"),
    ("church", "community"), ("clinic", "doctor"), ("hospital", "doctor"),
    ("law firm", "lawyer"),
)
WIKI_LISTING_TYPES = ("eat", "drink", "buy", "see", "do", "sleep", "go", "listing")
WIKI_LISTING_CATEGORY = (("eat", "restaurant"), ("drink", "restaurant"))

# ---- fixed values: default map from source place types to category slugs -----------
# (slug, parent, taxonomy values, basic categories, map tags)
CATEGORY_MAP = (
    ("restaurant", None,
     "persian_restaurant middle_eastern_restaurant afghani_restaurant",
     "restaurant fast_food_restaurant cafe coffee_shop casual_eatery food_service "
     "food_truck_stand food_court non_alcoholic_beverage_venue smoothie_juice_bar",
     "amenity=restaurant amenity=cafe amenity=fast_food amenity=ice_cream"),
    ("bakery", None, "bakery dessert_shop", "", "shop=bakery shop=pastry shop=confectionery"),
    ("grocery", None,
     "grocery_store international_grocery_store organic_grocery_store wholesale_grocer",
     "food_and_beverage_store superstore convenience_store warehouse_club_store",
     "shop=supermarket shop=convenience shop=greengrocer shop=deli shop=spices shop=nuts"),
    ("doctor/dentist", "doctor",
     "general_dentistry cosmetic_dentistry orthodontics pediatric_dentistry", "dental_clinic",
     "amenity=dentist healthcare=dentist"),
    ("doctor", None,
     "doctors_office walk_in_clinic pediatric_clinic public_health_clinic fertility_clinic "
     "primary_care_or_general_clinic",
     "outpatient_care_facility medical_service health_care primary_care_or_general_clinic "
     "specialized_health_care specialized_medical_facility walk_in_clinic pediatric_clinic "
     "behavioral_or_mental_health_clinic vision_or_eye_care_clinic "
     "physical_medicine_and_rehabilitation",
     "amenity=doctors amenity=clinic healthcare=*"),
    ("lawyer", None,
     "immigration_law immigration_and_naturalization_office real_estate_law tax_law "
     "civil_rights_lawyer",
     "attorney_or_law_firm legal_service", "office=lawyer office=notary"),
    ("real_estate", None, "real_estate_agent commercial_real_estate", "real_estate_service",
     "office=estate_agent"),
    ("beauty", None, "beauty_salon hair_salon nail_salon barber",
     "personal_or_beauty_service personal_care_and_beauty_store",
     "shop=hairdresser shop=beauty shop=cosmetics"),
    ("accounting", None, "accountant tax_service bookkeeper", "",
     "office=accountant office=tax_advisor"),
    ("translator", None, "translating_and_interpreting_service translation_service", "",
     "office=translator"),
    ("education", None,
     "language_school tutoring_service private_tutor day_care_preschool preschool school "
     "private_school elementary_school",
     "specialty_school tutoring_service educational_service place_of_learning preschool",
     "amenity=school amenity=language_school amenity=kindergarten"),
    ("community", None,
     "social_or_community_service community_center cultural_center religious_organization",
     "social_or_community_service community_center religious_organization civic_organization "
     "community_and_government",
     "amenity=community_centre amenity=place_of_worship amenity=social_centre club=*"),
    ("other", None, "", "", ""),
)

# ---- fixed values: sources ---------------------------------------------------------
# Also the survivorship order: earlier sources win when a field has several values.
SOURCE_ORDER = (
    "overture", "osm", "wikidata", "wikivoyage", "gov:la_business", "gov:vancouver_business",
    "gov:toronto_business", "gov:irs_eo_bmf", "gov:cra_charities", "gov:uk_charities",
    "gov:acnc_charities", "gov:fr_sirene", "directory:iranianbusinesscenter",
    "directory:bazaarche", "user_submission", "website", "telegram",
)
PLACE_TAXONOMY_MARKER = "persian_restaurant"
CLOSED_STATUS = "permanently_closed"
OSM_POI_KEYS = ("amenity", "shop", "office", "healthcare", "craft", "club", "tourism", "leisure")
OSM_NAME_HINTS = "persian|iranian|farsi|tehran|shiraz|isfahan|esfahan|tabriz|mashhad|persepolis"
OSM_LINK_KEYS = (
    "website", "contact:website", "contact:instagram", "contact:facebook", "contact:telegram",
    "facebook", "instagram",
)
ITEM_HINTS = "Persian|Iranian|Farsi|Tehran|Shiraz|Isfahan|Esfahan|Tabriz|Persepolis"
COMPANY_EXTRA_TERMS = ("persan", "iranien", "iranienne", "perse")
LA_PAGE = "https://data.lacity.org/Administration-Finance/Listing-of-Active-Businesses/6rrh-rzua"
VANCOUVER_PAGE = "https://opendata.vancouver.ca/explore/dataset/business-licences/"
TORONTO_PAGE = (
    "https://open.toronto.ca/dataset/municipal-licensing-and-standards-business-licences-and-permits/"
)
IRS_PAGE = (
    "https://www.irs.gov/charities-non-profits/exempt-organizations-business-master-file-extract-eo-bmf"
)
CRA_PAGE = "https://open.canada.ca/data/en/organization/cra-arc"
UK_CHARITY_PAGE = (
    "https://register-of-charities.charitycommission.gov.uk/charity-search/-/charity-details/"
)
ACNC_PAGE = "https://www.acnc.gov.au/charity/charities?search="
COMPANY_FR_PAGE = "https://annuaire-entreprises.data.gouv.fr/entreprise/"
WIKI_PAGE = "https://en.wikivoyage.org/wiki/"
OSM_PAGE = "https://www.openstreetmap.org/"
DIRECTORIES = {
    "directory:iranianbusinesscenter": {
        "home": "https://iranianbusinesscenter.com/",
        "own_domains": ("iranianbusinesscenter.com",),
        "own_socials": ("irbusinesscenter", "iranbusinesscenter", "iranianbusinesscenter_com"),
        "variant": "json_ld",
    },
    "directory:bazaarche": {
        "home": "https://bazaarche.ca/",
        "own_domains": ("bazaarche.ca",),
        "own_socials": ("bazaarche.ca", "bazaarche"),
        "variant": "heading",
    },
}

# ---- fixed values: gazetteer -------------------------------------------------------
PLACE_RANK = {"city": 0, "town": 1, "municipality": 1, "borough": 2, "suburb": 2, "village": 3}
EXTRA_PLACE_KINDS = ("city_district", "county")
EXCLUDED_COUNTRIES = ("IR", "AF", "TJ")
MIN_HALF_SPAN = 0.18
WIDEN = 0.25
MAX_SPAN = 1.2

# ---- fixed values: addresses and telephone plans (a subset of countries) ------------
# words before the number of a unit in an address
UNIT_WORDS = ("SUITE", "STE", "UNIT", "APT", "FLOOR", "FL", "RPO", "GROUND")
# country -> calling code, trunk prefix, international prefix, national number lengths
PHONE_PLANS = {
    "US": ("1", "1", "011", (7, 10)),
    "CA": ("1", "1", "011", (7, 10)),
    "DE": ("49", "0", "00", tuple(range(2, 16))),
    "GB": ("44", "0", "00", (4, 5, 6, 7, 8, 9, 10)),
    "SE": ("46", "0", "00", tuple(range(5, 13))),
    "NL": ("31", "0", "00", tuple(range(5, 12))),
    "FR": ("33", "0", "00", (9,)),
    "AU": ("61", "0", "0011", tuple(range(5, 13))),
    "TR": ("90", "0", "00", (7, 10, 12, 13)),
    "AE": ("971", "0", "00", tuple(range(5, 13))),
}
VERIFIED_SIGNAL = "user_submission_verified"
