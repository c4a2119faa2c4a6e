"""Results depend on these being exactly as they are.

Everything here is data (character tables, name hints, thresholds, wording of
reports). No logic lives in this module.
"""

# --- Fixed values: characters ------------------------------------------------
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"

# Letters replaced one for one; the zero-width non-joiner becomes a space.
LETTERS_FROM = "يىكۀة\u200c"
LETTERS_TO = "ییکهه "
# Right-to-left mark, left-to-right mark, byte order mark.
INVISIBLE_MARKS = "\u200f\u200e\ufeff"
# Arabic vowel signs.
DIACRITICS = "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0670"

CURRENCY_SIGNS = "$€£¥﷼"
# What NFKC turns the rial sign into.
RIAL_WORD = "ریال"
PERCENT_SIGNS = "%٪"
GROUP_SIGNS = "٬،"

# --- Fixed values: form of a Jalali date
JALALI_DATE = r"^(1[2-5]\d{2})[/\-.](\d{1,2})[/\-.](\d{1,2})$"

# --- Fixed values: missing-value spellings on CSV read ------------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: thresholds --------------------------------------------------
NUMBER_RATIO = 0.9
DATE_RATIO = 0.8
DATE_LIKE_RATIO = 0.95
LABEL_RATIO = 0.75
LABEL_CAP = 200
REJECTED_KEPT = 20
OUTLIER_IQR_FACTOR = 3.0
OUTLIER_MIN_ROWS = 20
OUTLIER_MAX_SHARE = 0.05
CONCENTRATION_SHARE = 30.0
CANCELLATION_RATE = 5.0
HIGH_DISCOUNT = 15.0
GIANT_ORDER_RATIO = 5.0
TOP_N = 10
SHARE_SLICES = 8
SHARE_MAX_GROUPS = 12
HISTOGRAM_BINS = 40
FILTER_OPTIONS = 50

# --- Fixed values: column-name hints -------------------------------------------
DATE_NAME_HINTS = ("date", "تاریخ", "زمان", "time")
MONEY_HINTS = (
    "amount", "total", "revenue", "sales", "price", "value", "cost", "usd",
    "eur", "irr", "مبلغ", "فروش", "قیمت", "درآمد", "هزینه", "ارزش",
)
QUANTITY_HINTS = ("quantity", "qty", "units", "count", "تعداد", "مقدار", "حجم")
PERCENT_HINTS = (
    "pct", "percent", "rate", "ratio", "discount", "tax",
    "درصد", "نرخ", "تخفیف", "مالیات",
)
ID_HINTS = ("id", "code", "number", "no", "شناسه", "کد", "شماره")
ORDER_HINTS = ("order", "invoice", "سفارش", "فاکتور")
PAYMENT_DAY_HINTS = ("day", "روز")
DISCOUNT_HINTS = ("discount", "تخفیف")
# In the order in which a text column's meaning is looked up.
TEXT_MEANINGS = (
    ("customer", ("customer", "client", "buyer", "account", "مشتری", "خریدار")),
    ("product", ("product", "item", "sku", "service", "کالا", "محصول", "خدمت")),
    ("region", ("region", "province", "state", "city", "country",
                "استان", "شهر", "منطقه", "کشور")),
    ("status", ("status", "state", "stage", "وضعیت", "حالت")),
    ("salesperson", ("salesperson", "seller", "agent", "rep",
                     "فروشنده", "کارشناس", "نماینده")),
    ("channel", ("channel", "source", "segment", "کانال", "بخش")),
    ("unit", ("unit", "uom", "واحد")),
)
DUPLICATE_ID_NAMES = ("id", "code", "order_id")

# --- Fixed values: status words --------------------------------------------------
NEGATIVE_STATUS_WORDS = (
    "cancel", "return", "refund", "void", "reject", "failed",
    "لغو", "مرجوع", "برگشت", "رد شده", "ابطال",
)
PENDING_STATUS_WORDS = (
    "pending", "await", "open", "unpaid", "در انتظار", "معوق", "باز",
)

# --- Fixed values: known spelling mistakes ---------------------------------------
LABEL_TYPOS = {"اصفهانن": "اصفهان", "تهرانـ": "تهران"}
COLUMN_TYPOS = {"Province": {"اصفهانن": "اصفهان", "اصفهان ": "اصفهان"}}

# --- Fixed values: report wording --------------------------------------------------
NO_COLUMN = "—"
LIST_COMMA = "، "
# Elected columns in the order in which rows are grouped by them.
DIMENSIONS = ("product", "customer", "region", "status")
OTHERS = "سایر"
ROLE_LABELS = {
    "date": "تاریخ", "measure": "عددی", "percent": "درصد",
    "category": "دسته‌بندی", "identifier": "شناسه", "text": "متن",
}
MEANING_LABELS = {
    "money": "مبلغ", "quantity": "مقدار", "customer": "مشتری", "product": "محصول",
    "region": "منطقه", "status": "وضعیت", "salesperson": "فروشنده",
    "channel": "کانال", "unit": "واحد", "id": "شناسه",
}
ROLE_REASONS = {
    "date": "نوع داده تاریخ",
    "percent": "نام ستون نشان‌دهنده درصد است",
    "numeric_id": "مقادیر یکتا و نام شبیه شناسه",
    "money": "سنجه مالی",
    "quantity": "سنجه مقداری",
    "generic": "ستون عددی",
    "text_id": "مقادیر عمدتاً یکتا",
    "free_text": "متن آزاد",
    "category": "تعداد محدود مقدار تکرارشونده",
    "varied": "تنوع بالای مقادیر",
}
ACTIONS = {
    "rename": ("اصلاح نام ستون",
               "فاصله‌های اضافی و کاراکترهای نامرئی از نام ستون‌ها حذف شد."),
    "drop_column": ("حذف ستون خالی",
                    "این ستون‌ها هیچ مقداری نداشتند و از تحلیل کنار گذاشته شدند."),
    "drop_row": ("حذف ردیف خالی", "ردیف‌هایی که هیچ مقداری نداشتند حذف شدند."),
    "text": ("یکسان‌سازی متن",
             "فاصله‌های اضافی، نیم‌فاصله و حروف عربی/فارسی یکسان‌سازی شدند."),
    "to_number": ("تبدیل به عدد",
                  "مقادیر متنی (جداکننده هزار، واحد پول و علامت درصد) به عدد تبدیل شدند."),
    "to_date": ("تبدیل به تاریخ",
                "قالب‌های مختلف تاریخ (میلادی و شمسی) به یک تاریخ استاندارد تبدیل شدند."),
    "merge": ("ادغام مقادیر مشابه", "مقادیر با املای نزدیک یکی شدند: {pairs}"),
    "drop_duplicate": ("حذف رکورد تکراری",
                       "ردیف‌هایی که در همه ستون‌ها کاملاً یکسان بودند حذف شدند."),
    "duplicate_id": ("شناسه تکراری (بدون حذف)",
                     "شناسه‌های تکراری گزارش شدند اما رکوردها حذف نشدند، "
                     "چون ممکن است اصلاحیه یا سفارش چندردیفی باشند."),
    "date_order": ("ترتیب روز و ماه",
                   "تاریخ‌های مبهم با {order} خوانده شدند: {day} تاریخ فقط با روز اول و {month} تاریخ فقط با ماه اول معنا دارد."),
}
DATE_ORDERS = {True: "روز اول", False: "ماه اول"}
REJECTED_NUMBERS = " {count} مقدار غیرقابل تفسیر خالی در نظر گرفته شد."
REJECTED_DATES = " {count} مقدار نامعتبر خالی در نظر گرفته شد."
MERGE_PAIR = "«{wrong}» → «{right}»"

HIGH, MEDIUM, LOW = "بالا", "متوسط", "کم"
ISSUES = {
    "missing": ("مقدار خالی", "{count:,} مقدار خالی ({share:,.1f}٪ رکوردها)"),
    "duplicate_rows": ("رکورد تکراری", "{count:,} رکورد کاملاً تکراری شناسایی و حذف شد"),
    "duplicate_ids": ("شناسه تکراری",
                      "{count:,} شناسه تکراری است؛ رکوردها حذف نشدند و نیاز به بررسی دارند"),
    "mixed_numbers": ("قالب عددی ناسازگار",
                      "مقادیری مانند {examples} در ستون عددی ذخیره شده‌اند"),
    "rejected": ("مقدار غیرقابل تفسیر",
                 "مقادیری مانند {examples} قابل تبدیل نبودند و خالی در نظر گرفته شدند"),
    "negative": ("مقدار منفی", "{count:,} مقدار منفی در ستونی که انتظار عدد مثبت می‌رود"),
    "outlier": ("مقدار پرت", "{count:,} مقدار بسیار دور از دامنه معمول (روش IQR)"),
    "bad_percent": ("درصد نامعتبر", "{count:,} مقدار خارج از بازه ۰ تا ۱۰۰"),
    "constant": ("ستون ثابت", "همه رکوردها یک مقدار دارند و برای تحلیل اطلاعاتی ندارد"),
}
NO_ID_COLUMN = "شناسه"

# key: (label, description)
KPI_TEXTS = {
    "total_rows": ("تعداد رکورد", "تعداد ردیف‌های داده پس از فیلترها"),
    "order_count": ("تعداد سفارش", "بر اساس مقادیر یکتای ستون «{column}»"),
    "total_sales": ("فروش خالص", "مجموع ستون «{column}»"),
    "average_order_value": ("میانگین ارزش سفارش", "میانگین مبلغ هر رکورد فروش"),
    "median_sale": ("میانه فروش", "نصف سفارش‌ها کمتر از این مبلغ هستند"),
    "largest_sale": ("بزرگ‌ترین سفارش", "بیشترین مبلغ یک رکورد"),
    "cancelled_value": ("مبلغ لغو/مرجوعی",
                        "{count:,} رکورد با وضعیت لغو یا مرجوعی از فروش خالص کنار گذاشته شد"),
    "total_quantity": ("مجموع مقدار", "مجموع ستون «{column}»"),
    "unique_customers": ("تعداد مشتری", "تعداد مشتریان یکتا پس از یکسان‌سازی نام‌ها"),
    "best_customer": ("بهترین مشتری", "{money} معادل {share:,.1f}٪ از کل فروش"),
    "best_product": ("پرفروش‌ترین محصول", "{money} معادل {share:,.1f}٪ از کل فروش"),
    "best_region": ("بهترین منطقه", "{money} معادل {share:,.1f}٪ از کل فروش"),
    "cancellation_rate": ("نرخ لغو و مرجوعی", "سهم رکوردهای {statuses} از کل رکوردها"),
    "pending_amount": ("مطالبات وصول‌نشده", "مجموع مبلغ رکوردهای {statuses}"),
    "mom_growth": ("رشد ماهانه", "مقایسه {last} با {previous}{note}"),
    "primary_measure_total": ("مجموع {column}", "مهم‌ترین ستون عددی شناسایی‌شده"),
    "primary_measure_average": ("میانگین {column}", "میانگین همان ستون"),
}
NET_SALES_EXCLUDING = "مجموع «{column}» بدون رکوردهای {statuses}"
PARTIAL_MONTH_NOTE = " (ماه جاری ناقص است و کنار گذاشته شد)"

INSIGHT_TEXTS = {
    "net_sales": "فروش خالص دوره {total} است{orders}.",
    "net_sales_orders": " در {orders} سفارش",
    "month_change": "فروش در {month} نسبت به ماه قبل {change:,.1f}٪ {direction} داشته است.{note}",
    "month_up": "رشد",
    "month_down": "افت",
    "month_note": " ماه جاری هنوز کامل نشده و در این مقایسه لحاظ نشده است.",
    "month_evidence": "{previous} → {last}",
    "month_range": "بهترین ماه {best} با {best_value} و ضعیف‌ترین ماه {worst} با {worst_value} بوده است.",
    "share_customer": "مشتری",
    "share_product": "محصول",
    "share": "{label} «{name}» با {money} معادل {share:,.1f}٪ از فروش را تشکیل می‌دهد.",
    "share_risk": " وابستگی درآمد به این یک مورد ریسک محسوب می‌شود.",
    "cancellation": "{rate} از رکوردها لغو یا مرجوع شده‌اند و از فروش خالص کنار گذاشته شدند.",
    "pending": "{money} از فروش هنوز وصول نشده است.",
    "pending_days": " میانگین دوره پرداخت {days:,.0f} روز است.",
    "discount": "میانگین تخفیف {mean:,.1f}٪ است.",
    "discount_high": " تعداد سفارش با تخفیف {limit:.0f}٪ یا بیشتر: {count:,}",
    "giant": "بزرگ‌ترین سفارش ({largest}) بیش از {times:,.1f} برابر میانگین است؛ "
             "پیش از تصمیم‌گیری صحت آن بررسی شود.",
    "negative": "{count:,} رکورد مبلغ منفی دارد که معمولاً نشانه برگشت از فروش یا خطای ثبت است.",
    "regions": "بیشترین فروش از «{best}» ({best_value}) و کمترین فروش از «{worst}» "
               "({worst_value}) به دست آمده است.",
    "basis": "این تحلیل بر پایه {rows:,} رکورد پس از پاک‌سازی و فیلترهای فعال است.",
}

GRAIN_LABELS = {"quarter": "فصل", "month": "ماه", "week": "هفته", "day": "روز"}
# key: (title, description)
ROLLUP_TEXTS = {
    "trend": ("روند {measure}",
              "مجموع {measure} در هر {grain}؛ برای دیدن رشد یا افت در طول زمان."),
    "top": ("برترین‌های {dimension}",
            "سهم هر {dimension} از {measure}؛ برای شناسایی تمرکز فروش."),
    "share": ("سهم {dimension}", "درصد مشارکت هر {dimension} در {measure}."),
    "status": ("وضعیت {dimension}",
               "ترکیب وضعیت سفارش‌ها؛ سهم لغو و مرجوعی را نشان می‌دهد."),
    "distribution": ("توزیع {measure}",
                     "پراکندگی مقادیر؛ برای تشخیص سفارش‌های خیلی بزرگ یا خیلی کوچک."),
}

ERRORS = {
    "format": "فرمت فایل پشتیبانی نمی‌شود. لطفاً فایل CSV یا Parquet بارگذاری کنید.",
    "no_rows": "فایل بارگذاری‌شده هیچ داده‌ای ندارد.",
    "no_usable_rows": "فایل بارگذاری‌شده داده قابل استفاده‌ای ندارد.",
    "not_a_dataframe": "Input data must be a Spark DataFrame.",
    "empty": "Dataset is empty.",
}
