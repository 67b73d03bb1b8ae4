"""Word lists, character sets, patterns and limits that results depend on."""

# Fixed values.  They decide what is found and how spellings are compared, and are kept as they are.
QUOTES = "«»“”‘’\"'"
DASHES = "-‐‑‒–—―"
PUNCTUATION = "«»“”‘’\"'.,;:()[]{}/\\|"
VOWELS = "аеёиоуыэюяйьъ"
ENDING = "[а-яёА-ЯЁ]"
GENERIC = [
    "компания", "клиент", "заказчик", "исполнитель", "подрядчик", "сотрудник", "руководитель", "директор",
    "бухгалтер", "аудитор", "пользователь", "система", "общество", "организация", "отчет", "отчёт", "документ",
    "приложение", "company", "client", "customer", "vendor", "employee", "manager", "user", "system", "report",
    "document", "appendix", "n/a", "none", "unknown",
]
LEGAL_FORMS = [
    "ооо", "оао", "зао", "пао", "ао", "ип", "нао", "нко", "гуп", "муп", "фгуп", "пкф", "тд", "чоу", "ано", "фонд",
    "llc", "ltd", "limited", "inc", "corp", "co", "gmbh", "ag", "plc", "jsc", "pjsc", "sa", "sas", "bv", "nv", "oy",
    "ab", "as", "spa", "srl", "kft", "zoo",
]
LEGAL_PREFIXES = ["ООО", "АО", "ПАО", "ЗАО", "ИП", "ОАО", "LLC", "Ltd", "Inc", "GmbH"]
CATEGORIES = ["PERSON", "ORG", "LOCATION", "EMAIL", "PHONE", "URL", "ID_NUMBER", "ACCOUNT", "SYSTEM", "OTHER"]
LANGUAGES = ["ru", "en"]
THINKING = ["think", "thinking", "reasoning"]
TAG_PREFIX, TAG_SUFFIX = "[[", "]]"
REDACTED, RESTORED = "__redacted", "__restored"
SUPPORTED = [".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm"]
LEGACY = [".doc", ".rtf", ".xls", ".ppt"]
MEDIA_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".docm": "application/vnd.ms-word.document.macroEnabled.12",
    ".xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    ".pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
}
LAYERS = ["schema_contract", "business_rules", "context_data", "examples", "task"]
ACKNOWLEDGED = {
    "schema_contract": "Schema contract received. Awaiting business rules.",
    "business_rules": "Business rules understood. Ready for context or examples.",
    "context_data": "Context loaded and indexed internally. Awaiting examples or execution trigger.",
    "examples": "Examples received. Ready for the execution trigger.",
}
#: Detector name to (category, pattern as Java reads it, group that holds the value), in the order they run.
DETECTORS = {
    "EMAIL": ("EMAIL", r"(?<![\w.])[\w.+-]+@[\w-]+\.[\w.-]*[a-zA-Z](?![\w-])", 0),
    "PHONE": ("PHONE", r"(?<![\d\w])(?:\+7|8|\+\d{1,3})[\s\-(]*\d{2,4}[\s\-)]*\d{2,3}[\s\-]?\d{2}[\s\-]?\d{2,3}(?![\d\w])", 0),
    "URL": ("URL", r"(?<!\S)(?:https?://|www\.)[^\s<>\"'»]+", 0),
    "INN": ("ID_NUMBER", r"(?:ИНН|INN)[\s:№.]*(\d{10}|\d{12})(?!\d)", 1),
    "OGRN": ("ID_NUMBER", r"(?:ОГРН(?:ИП)?|OGRN)[\s:№.]*(\d{13}|\d{15})(?!\d)", 1),
    "SNILS": ("ID_NUMBER", r"(?<!\d)\d{3}-\d{3}-\d{3}\s\d{2}(?!\d)", 0),
    "IBAN": ("ACCOUNT", r"(?<![A-Z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Z0-9])", 0),
    "CARD": ("ACCOUNT", r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)", 0),
}
MAX_FILES, MAX_UPLOAD_MB, JOB_TTL_MINUTES, CHUNK_CHARS = 25, 50, 240, 9000
SLOW_MS, POLL_SAMPLE, STALL_SECONDS, POLL_MISSES = 2000, 20, 90, 4
FINAL_STATUS = [400, 401, 403, 404, 422]
