"""Word lists, patterns and weights that results depend on.

Everything in this module is a fixed value: the lists below decide routes, boosts, noise lines and record
fields, and are stated as they are needed, in their natural order.
"""

# --- Fixed values: query routing -------------------------------------------------------------------------
AMBIGUOUS_QUERIES = ("الباقة", "السعر", "عايز أعرف", "price?", "package?")
SHORT_CODES = ("111", "*550#", "#550*")
OUT_OF_SCOPE_TERMS = ("vodafone", "orange", "etisalat", "private customer data", "personal bill", "فودافون", "اورانج", "اتصالات")
UNSAFE_TERMS = ("illegal bypass", "bypass", "hacking", "hack")
CATEGORY_TERMS = {
    "faq": ("sim swap", "customer service number", "useful numbers", "bill payment dates", "line validity", "fixed voice", "خدمة العملاء", "أرقام تهمك", "مواعيد سداد", "الخط الأرضي"),
    "devices": ("router", "device", "phone", "cordless", "handset", "model", "tp-link", "dex", "d1005", "vn020", "zxhn", "iphone", "samsung", "tplink", "zte", "huawei", "جهاز", "راوتر", "تليفون", "موبايل", "هاتف", "لاسلكي", "موديل", "ده ايه", "دا ايه", "سعره", "مواصفاته"),
    "we_home": ("we space", "we air", "we sonic", "we life", "super", "mega", "ultra", "max", "gb", "internet", "جيجا", "الإنترنت الأرضي", "النت الأرضي", "باقة انترنت", "انترنت", "نت"),
    "services": ("كود", "code", "رصيد", "balance", "سلفني", "apple pay", "my we", "تحويل رصيد", "خدمة"),
}
PRICE_QUERY_TERMS = ("price", "سعر")
SIMPLE_TERMS = ("code", "cost", "fee", "number", "quota", "speed", "validity", "price", "balance", "sim swap")
MEDIUM_TERMS = ("list", "how", "subscribe", "terms", "available", "packages", "addons", "add-ons", "requirements")
COMPLEX_TERMS = ("compare", "comparison", "recommend", "better", "summarize", "summary", "analyze", "analysis", "gaming", "uploaded", "pdf")
LONG_QUERY_WORDS, SHORT_QUERY_WORDS = 18, 8
#: mode: dense k, sparse k, candidates, final.
MODE_BUDGETS = {"fast": (10, 10, 10, 3), "standard": (30, 30, 20, 5), "deep": (50, 50, 30, 8)}
UPLOAD_BUDGET = (20, 20, 20, 5)
BOTH_FINAL, BOTH_SIDE = 8, 5

# --- Fixed values: entities in queries --------------------------------------------------------------------
IGNORED_CAPITALS = (
    "Tell", "Can", "Please", "Explain", "What", "How", "Why", "When", "Where", "Is", "Are", "Do", "Does", "Show", "Give", "Help", "Did", "Was", "Were", "Has",
        "Had", "Have", "Could", "Would", "Should", "Which", "May", "Might", "Shall", "Must", "Will",
    "About", "Also", "And", "Any", "But", "For", "From", "Get", "Got", "Its", "Not", "Okay", "The", "This", "That", "With", "Who", "Whom", "Your", "Our", "His", "Her", "They", "Them", "Some", "Each", "All", "Both", "Such", "Than", "Then",
)
DEVICE_NAMES = ("DEX", "Cordless", "D1005", "VN020", "ZXHN", "Huawei", "ZTE", "TP-Link")
STOPWORDS = ("what", "is", "the", "for", "and", "are", "how", "can", "i", "a", "an")

# --- Fixed values: metadata boosts ------------------------------------------------------------------------
BOOST_CAP = 0.35
CODE_QUERY_TERMS = ("code", "*", "#", "كود", "balance", "رصيد")
CODE_RECORD_TYPES = ("service_code", "service_detail", "service_fee")
PRICE_BOOST_TERMS = ("price", "cost", "fee", "egp", "سعر", "تكلفة", "رسوم", "كام", "جنيه")
PRICE_UNITS = ("egp", "le", "جنيه", "قروش")
HOME_QUERY_TERMS = ("we space", "we air", "we sonic", "we life", "super", "mega", "ultra", "max", "gb", "internet", "جيجا", "انترنت", "نت")
DEVICE_QUERY_TERMS = ("router", "راوتر", "device", "iphone", "samsung", "tp-link", "zte", "huawei", "موبايل", "هاتف")
PACKAGE_TYPES = ("package", "yearly_package", "add_on")
HOTLINE_TERMS = ("customer service", "call center", "hotline", "خدمة العملاء")

# --- Fixed values: records --------------------------------------------------------------------------------
CITATION_FIELDS = ("citation_url", "canonical_url", "final_url", "detail_url", "source_url", "listing_url")
TITLE_FIELDS = ("question", "product_name", "service_name", "package_name", "add_on_name", "section_title", "title", "record_id", "doc_id")
UNTITLED = "Untitled Record"
CATEGORY_ALIASES = {"faq": "faq", "faqs": "faq", "device": "devices", "devices": "devices", "service": "services", "services": "services", "we_home": "we_home", "home": "we_home"}
COMMON_METADATA = ("language_pair_key", "alternate_language_url", "source_url", "final_url", "canonical_url", "detail_url", "listing_url", "quality_flags")
CATEGORY_METADATA = {
    "faq": ("question", "answer", "faq_number"),
    "devices": ("product_name", "normalized_product_name", "brand", "manufacturer", "device_category", "price", "price_numeric", "currency", "specifications", "warranty", "model", "availability"),
    "services": ("service_name", "normalized_service_name", "service_category", "service_category_display", "subscription_code", "ussd_codes", "sms_number", "sms_format", "fee", "fee_notes", "price", "price_numeric", "currency", "currency_subunit", "minimum_payment", "maximum_payment", "service_channel", "search_aliases", "terms_and_conditions", "requirements", "eligibility", "steps"),
    "we_home": ("pillar", "product_family", "tier", "package_name", "normalized_package_name", "quota", "quota_gb", "quota_tb", "speed", "download_speed", "upload_speed", "monthly_fee", "monthly_fee_egp", "yearly_fee", "yearly_fee_egp", "price", "price_egp", "currency", "billing_cycle", "validity", "renewal_type", "price_includes_vat", "vat_note", "payment_channels", "search_aliases", "features", "benefits", "terms_and_conditions"),
}
INDEX_LABELS = {
    "question": "Question", "answer": "Answer", "faq_number": "FAQ number", "product_name": "Product", "normalized_product_name": "Normalized product",
        "brand": "Brand", "manufacturer": "Manufacturer", "device_category": "Device category", "model": "Model", "availability": "Availability",
        "specifications": "Specifications", "warranty": "Warranty",
    "service_name": "Service", "normalized_service_name": "Normalized service", "service_category": "Service category",
        "service_category_display": "Service category display", "subscription_code": "Code", "ussd_codes": "USSD codes", "sms_number": "SMS number",
        "sms_format": "SMS format", "fee": "Fee", "fee_notes": "Fee notes", "minimum_payment": "Minimum payment", "maximum_payment": "Maximum payment",
        "service_channel": "Service channel", "requirements": "Requirements", "eligibility": "Eligibility", "steps": "Steps",
    "pillar": "Pillar", "product_family": "Product family", "tier": "Tier", "package_name": "Package", "normalized_package_name": "Normalized package",
        "quota": "Quota", "quota_gb": "Quota GB", "quota_tb": "Quota TB", "speed": "Speed", "download_speed": "Download speed", "upload_speed": "Upload speed",
        "monthly_fee": "Monthly fee", "monthly_fee_egp": "Monthly fee", "yearly_fee": "Yearly fee", "yearly_fee_egp": "Yearly fee", "price": "Price",
        "price_numeric": "Price numeric", "price_egp": "Price", "currency": "Currency",
    "billing_cycle": "Billing cycle", "validity": "Validity", "renewal_type": "Renewal type", "price_includes_vat": "Price includes VAT",
        "vat_note": "VAT note", "payment_channels": "Payment channels", "search_aliases": "Aliases", "features": "Features", "benefits": "Benefits",
        "terms_and_conditions": "Terms and conditions",
}
CHUNK_INDEX_FIELDS = ("service_name", "product_name", "package_name", "brand", "product_family", "tier", "quota", "quota_gb", "quota_tb", "speed",
    "download_speed", "upload_speed", "subscription_code", "ussd_codes", "price", "price_numeric", "price_egp", "monthly_fee", "monthly_fee_egp", "yearly_fee",
    "yearly_fee_egp", "fee", "fee_notes", "search_aliases")
ATOMIC_TYPES = ("faq", "product", "service_code", "service_fee", "package", "package_tier", "package_price", "yearly_package", "add_on", "payment_channels", "salefny_rule", "renewal_rule", "early_renewal_rule", "hardware", "table_row")
MOBILE_CATEGORIES = ("prepaid", "control_plans", "postpaid", "mobile_internet", "value_added_services")
MOBILE_TYPES = ("plan", "package", "add_on", "service_code", "service_detail", "service_fee", "terms", "benefit", "faq_like", "detail")

# --- Fixed values: noise ------------------------------------------------------------------------------------
NOISE_PHRASES = (
    "remove", "add to compare", "compare", "details", "more details", "subscribe now", "back to top", "return to top", "mobile services details page",
        "personal", "home", "menu", "close", "next", "previous", "back", "add", "add products", "add product", "add another product", "clear all", "recharge now",
        "mobile", "control", "bundle services", "choose your plan", "recommended", "recommanded", "visit", "sorry. there are no products to compare",
    "حذف", "حذف الكل", "أضف للمقارنة", "اضف للمقارنة", "إضافة للمقارنة", "اشترك الان", "اشترك الآن", "تفاصيل اكتر", "تفاصيل أكثر", "الرجوع الى الأعلى",
        "الرجوع الي الأعلي", "القائمة", "اغلاق", "إغلاق", "التالي", "السابق", "رجوع", "أضف منتج", "أضف منتج آخر", "المقارنة",
)
#: Lines that are navigation on pages of each section, and in cleaned content of mobile records.
MOBILE_NOISE = ("home", "personal", "business", "about us", "contact us", "search", "login", "my account", "back to top", "facebook", "twitter", "instagram", "youtube", "english", "العربية")
MOBILE_NOISE_STARTS = ("copyright", "all rights reserved")
PUBLIC_NOISE = ("home", "personal", "business", "about us", "contact us", "search", "login", "my account", "english", "العربية", "facebook", "twitter", "instagram", "youtube", "linkedin")
BUSINESS_NOISE = (
    "remove", "add to compare", "compare", "details", "more details", "subscribe now", "back to top", "business", "personal", "menu", "close", "next", "previous", "home", "login", "search", "english",
    "العربية", "حذف", "أضف للمقارنة", "اضف للمقارنة", "اشترك الان", "اشترك الآن", "تفاصيل اكتر", "تفاصيل أكثر", "الرجوع الى الأعلى", "القائمة", "اغلاق", "إغلاق", "التالي", "السابق", "الرئيسية",
)
SECTION_NOISE = (
    "remove", "add to compare", "compare", "details", "more details", "subscribe now", "back to top", "business", "personal", "menu", "close", "next",
        "previous", "home", "products comparison", "compare products", "all rights reserved", "login", "search", "english",
    "العربية", "حذف", "أضف للمقارنة", "اضف للمقارنة", "اشترك الان", "اشترك الآن", "تفاصيل اكتر", "تفاصيل أكثر", "الرجوع الى الأعلى", "القائمة", "اغلاق", "إغلاق", "التالي", "السابق", "الرئيسية", "مقارنة المنتجات", "جميع الحقوق محفوظة",
)
GENERIC_NOISE = ("remove", "add to compare", "compare", "details", "more details", "subscribe now", "back to top", "business", "personal", "menu", "close", "next", "previous", "home")
NAVIGATION_HINTS = ("home", "personal", "business", "contact us", "login", "my account", "search", "back to top")
LABEL_PREFIXES = ("title:", "category:", "record type:", "language:", "source:", "content:", "metadata:", "source type:", "source_name:", "retriever:")
TYPE_WORDS = ("service_detail", "eligibility", "service_fee", "subscription_method")
NOT_FOUND_SIGNALS = (
    "لم أجد", "لم يتم العثور", "لم أتمكن من العثور", "غير متوفر", "لا تتوفر", "لا توجد معلومات", "i could not find", "could not find this information",
        "not found in the", "no information", "is not available in", "not mentioned in", "does not contain", "no relevant information",
)

# --- Fixed values: amounts ----------------------------------------------------------------------------------
PRICE_UNIT = r"EGP|LE|L\.E|جنيه|ج\.م|جم|PT|قرش|قروش"
SUBUNITS = ("pt", "قرش", "قروش")
MOBILE_PRICE = rf"(?i)(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?)[ \t\r\n]*({PRICE_UNIT})"
BUSINESS_PRICE = rf"(?i)(\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?)[ \t\r\n]*({PRICE_UNIT})"
MOBILE_QUOTA = r"(?i)(\p{Nd}+(?:[.,]\p{Nd}+)?)[ \t\r\n]*(GB|G\.B|MB|M\.B|جيجابايت|جيجا|ميجابايت|ميجا)"
GIGABYTES = ("gb", "g.b", "جيجابايت", "جيجا")
BUSINESS_QUOTA = r"(?i)(\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?)[ \t\r\n]*(GB|G\.B|MB|M\.B|SMS|units?|minutes?|sessions?|channels?|SIMs?|invoices?|rack units?|RU|bandwidth|domains?)"
USSD = r"(?U)(?<!\w)(?:\*\p{Nd}{2,6}(?:\*\p{Nd}{1,6})*#?|#\p{Nd}{2,6}\*?)(?!\w)"
MOBILE_CODE = r"(?U)(?<!\w)(?:[#*][0-9][0-9#*]{1,18}[#*]?)(?!\w)"
PUBLIC_QUOTA = r"(?i)\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?\s*(?:GB|G\.B|MB|M\.B|جيجابايت|جيجا|ميجابايت|ميجا)"
KIX_UNITS = r"(?i)(\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}{3,6})[ \t\r\n]*(?:Kix|كيكس)"
CONSUMPTION = r"(?i)(?:^|\s)(?:\p{Nd}+\s*)?(?:Kix|كيكس)\s*=\s*.+"
VALID_DAYS = r"(\p{Nd}+)[ \t\r\n]*(day|days|يوم|أيام|ايام)"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?U)(?<!\w)(?:\+?20)?\s?\p{Nd}{2,4}[\s-]?\p{Nd}{3,4}[\s-]?\p{Nd}{3,4}(?!\w)"
DATE = r"(?iU)\b(?:19|20)\p{Nd}{2}\b|\b\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-](?:19|20)?\p{Nd}{2}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\p{Nd}{1,2},?\s+\p{Nd}{4}\b"
IMPORTANT = r"(?i)(\*\p{Nd}+[#*]?|#\p{Nd}+\*?|\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?|egp|le|gb|mbps|جنيه|قرش|قروش)"
VALUE = r"(?i)\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?[ \t\r\n]*(?:egp|le|pt|gb|mbps|جنيه|قرش|قروش)"
SOURCE_CODE = r"(?U)\*\s*\p{Nd}+(?:\s*\*\s*[\w؀-ۿ]+)*\s*#?"
LOW_RELEVANCE = 0.35

# --- Fixed values: pages ------------------------------------------------------------------------------------
#: Last part of a business page's address: its category and the heading above it.
BUSINESS_PAGES = {
    ("business_mobile_services", "Mobile Rate Plans & solutions"): ("we-business", "we-buissnes-value", "we-business-prepaid", "we-buissnes-internet", "we-data-hub", "m2m-shared-data", "smart-meters", "we-business-sms", "fleet-tracking-service", "we-air-business"),
    ("business_data_connectivity", "Enterprise Infrastructure Transit & Media"): ("business-adsl", "ip-transit", "ip-vpn", "transmission-media"),
    ("business_voice_services", "Fixed Line & Corporate Telephony routing"): ("business-landline", "voice-plans", "short-number", "toll-free-numbers", "voice-service-0900", "pri-circuit", "sip-trunk-service", "marketing-calls"),
    ("business_hosting_data_center", "Data Infrastructure, VPS & Racks"): ("data-center-co-location", "dedicated-hosting", "virtual-private-servers", "shared-hosting"),
    ("business_digital_solutions", "Managed ICT, Cloud Platforms & Security"): ("we-access", "ddos-protection", "hosted-call-center", "managed-ip-telephony", "video-conferencing-meet-me", "smart-solutions", "e-invoice", "we-cloud-erp", "we-fintech"),
    ("business_wholesale", "Carrier Solutions & Peering"): ("wholesale",),
}
BUSINESS_DEFAULT = ("business", "WE Business")
#: Labels of built content: Arabic, English.
LABELS = {
    "plan": ("الخدمة/الباقة", "Plan or service"), "service": ("الخدمة", "Service"), "category": ("الفئة", "Category"), "description": ("الوصف", "Description"),
        "price": ("السعر", "Price"), "quota": ("السعة", "Quota"), "allowance": ("السعة", "Quota or allowance"), "codes": ("الأكواد", "Codes"),
    "benefits": ("المميزات", "Benefits"), "features": ("المميزات", "Features"), "terms": ("الشروط والأحكام", "Terms and conditions"),
        "details": ("التفاصيل", "Details"), "section": ("القسم", "Section"), "topic": ("الموضوع", "Topic"), "title": ("العنوان", "Title"),
}
#: Topics of section pages: the first whose words stand in title or address.
SUSTAINABILITY = "corporate_sustainability"
ABOUT = "about_te"
SUSTAINABILITY_TOPICS = ((("climate",), "Climate Change"), (("quality", "iso", "esms"), "Corporate Quality"), (("sustainability",), "Sustainability"))
SUSTAINABILITY_TOPIC = "Corporate Sustainability"
ABOUT_TOPICS = ((("board",), "Board of Directors"), (("management",), "Management Team"), (("museum",), "TE Museum"), (("history",), "History"),
    (("award",), "Awards"), (("strategy",), "Corporate Strategy"), (("press",), "Press Releases"), (("tv",), "TV Ads"),
    (("career", "training"), "Careers and Training"), (("contact",), "Contact Information"))
ABOUT_TOPIC = "About TE"
SPECIAL_CARDS = ("history_milestone", "award", "press_release", "tv_ad")
#: Categories of public pages: the first whose words stand in the address.
PUBLIC_CATEGORIES = ((("/business",), "business"), (("/support", "/help"), "support"), (("/offer",), "offers"), (("/branch", "stores"), "branches"),
    (("/mobile",), "mobile"), (("/devices", "/w/"), "public_site"), (("/personal",), "personal"))
PUBLIC_CATEGORY, PUBLIC_UNTITLED = "public_site", "Untitled public page"
#: What a business record's title adds to its aliases.
BUSINESS_ALIASES = (
    (("business value",), ("WE Business Value", "business value plan", "corporate value plan")),
        (("we business",), ("WE Business", "business mobile plan", "corporate mobile plan", "business control plan")),
        (("sms",), ("WE Business SMS", "business bulk SMS", "corporate SMS package")),
    (("data hub",), ("WE Data Hub", "shared corporate data pool", "corporate shared data SIMs")),
        (("air", "fwa"), ("WE Air Business", "Business FWA", "Fixed Wireless Access business")), (("sip",), ("SIP Trunk",)), (("pri",), ("PRI Circuit",)),
        (("toll free",), ("Toll Free Numbers",)), (("0900",), ("0900 service",)),
    (("hosting",), ("Shared Hosting", "Linux cPanel hosting", "Windows Plesk hosting")), (("vps", "virtual private"), ("VPS", "IaaS", "virtual server")),
        (("ddos",), ("DDoS Protection",)), (("invoice",), ("E-Invoice", "Egyptian Tax Authority e-invoice")),
)
#: What a mobile record's name adds to its aliases; {} is the number behind the name, with a space before it, if there is one.
MOBILE_ALIASES = (
    ("super kix", r"(?i)super\s*kix\s*(\p{Nd}+)", ("Super Kix{}", "Super Kix", "سوبر كيكس{}", "سوبر كيكس", "WE Super Kix", "كود Super Kix{}", "باقة Super Kix{}")),
    ("nitro", None, ("Nitro", "نيترو")),
    ("nitro prime", None, ("Nitro Prime",)),
    ("nitro extra", None, ("Nitro Extra",)),
    ("nitro mifi", None, ("Nitro MiFi",)),
    ("we gold", r"(?i)we\s*gold\s*(\p{Nd}+)", ("WE Gold{}", "وي جولد{}")),
)
#: Sources of the knowledge base where no registry names others.
DEFAULT_SOURCES = (("faq", "data/processed/faq/faq_post_processed.jsonl"), ("devices", "data/processed/devices/devices_post_processed_v2.jsonl"),
    ("services", "data/processed/services/services_post_processed_v3.jsonl"), ("we_home", "data/processed/we_home/we_home.jsonl"))

# --- Fixed values: sentences of deterministic answers, Arabic and English -------------------------------------
ANSWER_TEXTS = {
    "balance_code": ("كود معرفة الرصيد هو ", "You can check your balance by dialing "),
    "service_fee": ("، ورسوم الخدمة ", ". The service fee is "),
    "uploaded": ("المعلومة المتاحة من المستند هي: ", "The uploaded document says: "),
    "official": ("المعلومة المتاحة من المصدر الرسمي هي: ", "The available official source says: "),
    "quota": ("السعة ", "quota "),
    "speed": ("السرعة ", "speed "),
    "price": ("السعر ", "price "),
    "device_is": (" هو جهاز ", " is "),
    "device_price": ("، سعره ", " priced at "),
    "device_warranty": ("، ويأتي بضمان ", ". It includes "),
    "device_facts": (". من مواصفاته: ", " and features "),
    "one_year": ("سنة", "a 1-year warranty"),
}
DEVICE_LABELS = {
    "fixed landline phones": ("تليفون أرضي", "landline phone"),
    "cordless fixed landline phones": ("تليفون أرضي لاسلكي", "cordless landline phone"),
    "routers": ("راوتر", "router"),
    "accessories": ("إكسسوار", "accessory"),
}

# --- Fixed values: names of mobile categories, English and Arabic, and slugs that name no page ----------------
MOBILE_LABELS = {
    "prepaid": ("Prepaid", "باقات مدفوعة مقدما"),
    "control_plans": ("Control Plans", "باقات كنترول"),
    "postpaid": ("Postpaid / WE Gold", "باقات وي جولد"),
    "mobile_internet": ("Mobile Internet", "إنترنت الموبايل"),
    "value_added_services": ("Value Added Services", "خدمات إضافية"),
}
EMPTY_SLUGS, UPPER_SLUGS = ("w", "guest", "mobile"), ("we", "pt")
