"""Values that the results depend on: word lists, patterns, points, texts, limits."""

# --- Fixed values: file types -------------------------------------------------------------------------------
SUPPORTED_EXTS = (".pdf", ".docx", ".xlsx", ".pptx", ".rtf", ".xls")
OOXML_EXTS = (".docx", ".xlsx", ".pptx")
OFFICE_RULE_EXTS = (".docx", ".docm", ".xlsm", ".pptm", ".pptx", ".xlsx")
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".rtf": "application/rtf",
}
DEFAULT_MIME = "application/octet-stream"
OLE_HEADER_HEX = "D0CF11E0A1B11AE1"

# --- Fixed values: feature tokens ---------------------------------------------------------------------------
OFFICE_TOKENS = (
    "CreateObject", "Shell", "WScript", "URLDownloadToFile", "ADODB.Stream", "WinExec", "cmd.exe",
    "PowerShell", "Msxml2.XMLHTTP",
)
PDF_JS_TOKENS = ("/JS", "/JavaScript")
PDF_OPEN_TOKENS = ("/OpenAction", "/AA")
PDF_URI_TOKENS = ("/URI", "/GoToR")
PDF_EMBED_TOKENS = ("/EmbeddedFile", "/EmbeddedFiles")
PDF_MARKER_TOKENS = ("/JavaScript", "/OpenAction", "/AA", "/Launch")
PDF_PAGE_TOKENS = ("/Type/Page", "/Type /Page")
# A URL runs up to Unicode white space or a backslash. The class is spelled out because the engines
# disagree on what \s covers.
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = r"(?i)https?://[^" + WHITESPACE_CLASS + r"\\]+"

# --- Fixed values: rules ------------------------------------------------------------------------------------
SUSPICIOUS_STRINGS = (
    "javascript", "<script", "eval(", "wscript.shell", "powershell", "activexobject", "shell(", "cmd.exe",
    "mshta", "autoopen", "document.open", "base64,", "fromcharcode(", "createobject(",
)
PDF_FALLBACK_PATTERNS = ("/JavaScript", "/JS", "/Launch", "/OpenAction", "/AA")
RTF_CONTROL_PATTERNS = (
    r"\\objupdate", r"\\object", r"\\objdata", r"\\pict", r"\\field", r"\\*\s*generator",
)
LAUNCH_SUBTYPES = ("/Launch", "/SubmitForm", "/ImportData")
RULE_POINTS = {
    "suspicious_strings": 15,
    "pdf_exploit_action": 80,
    "pdf_js_auto": 50,
    "pdf_aa_action": 40,
    "pdf_names_js": 50,
    "pdf_deep_js": 60,
    "pdf_regex_match": 65,
    "office_macro": 70,
    "office_ole": 20,
    "rtf_exploit": 70,
    "high_entropy": 20,
}
RULE_SEVERITY = {
    "suspicious_strings": "medium",
    "pdf_exploit_action": "critical",
    "pdf_js_auto": "high",
    "pdf_aa_action": "high",
    "pdf_names_js": "high",
    "pdf_deep_js": "high",
    "pdf_regex_match": "high",
    "office_macro": "high",
    "office_ole": "medium",
    "rtf_exploit": "high",
    "high_entropy": "medium",
}
RULE_MESSAGES = {
    "suspicious_strings": "Suspicious strings found: ",
    "pdf_exploit_action": "PDF Auto-Launch Action detected (%s).",
    "pdf_js_auto": "PDF OpenAction executes JavaScript.",
    "pdf_aa_action": "PDF contains global Auto-Actions (AA).",
    "pdf_names_js": "PDF contains named JavaScript scripts.",
    "pdf_deep_js": "Hidden JavaScript/Launch actions found in objects.",
    "pdf_regex_match": "PDF contains potentially malicious script patterns (fallback scan).",
    "office_macro": "Office document contains VBA Macros (vbaProject.bin).",
    "office_ole": "Office document contains embedded OLE objects.",
    "rtf_exploit": "RTF contains potentially malicious control words.",
    "high_entropy": "High entropy (%s) indicates packed/encrypted content.",
}
HIGH_ENTROPY_BITS = 7.2
RECOMMENDATIONS = (
    "Do not open this file on a production workstation.",
    "Use the sanitized version if available.",
    "Disable Macros in Microsoft Office Trust Center.",
    "Disable JavaScript in your PDF Viewer.",
)
EXPLANATIONS = {
    "macro": "This Office document contains a VBA macro that may run code when content is enabled.",
    "javascript": "This PDF declares JavaScript or auto-run actions, often abused to execute code on open.",
    "embedded": "Embedded object/file detected; payloads can be hidden inside embedded objects.",
    "rtf": "RTF object/field constructs detected; these are frequently abused to launch external content.",
}
SNIPPET_KEYWORDS = (
    "javascript", "openaction", "vbaproject", "shell", "powershell", "cmd.exe", "eval(", "<script",
    "createobject", "activex", "autoopen",
)
THREATS = {
    "pdf_has_javascript": ("JavaScript Code", "high", "PDF /JavaScript or /OpenAction detected", "Removed"),
    "has_vba_project": ("Macro Function", "high", "vbaProject.bin present", "Neutralized"),
    "embedded_files_count": ("Embedded Content", "medium", "%s embedded file(s)", "Stripped"),
    "none": ("No active threats", "low", "No dangerous constructs found", "N/A"),
}
BLEND_WEIGHTS = {"dl": 0.35, "lgbm": 0.35, "tree": 0.20, "rules": 0.10}

# --- Fixed values: plans ------------------------------------------------------------------------------------
PLAN_LIMITS = {
    "FREE": {"scans": 3, "api_calls": 100, "storage_mb": 100},
    "PRO": {"scans": 100, "api_calls": 5000, "storage_mb": 10000},
    "ENTERPRISE": {"scans": -1, "api_calls": -1, "storage_mb": -1},
}
RETENTION_HOURS = 48

# --- Fixed values: scrubbing --------------------------------------------------------------------------------
RTF_LIGHT_BLOCK = r"(?is)\\object\b.*?\\endobj\b"
RTF_LIGHT_WORDS = r"(?i)\\(objdata|objclass|field|pict)\b"
# label and pattern, in the order they are applied; every match becomes one space
RTF_FULL_STEPS = (
    ("object", r"(?is)\\object\b.*?\\endobj"),
    ("objdata", r"(?is)\\\*?\\objdata\b.*?\}"),
    ("ddefield", r"(?is)\{\\field\b.*?\\fldinst\b[^}]*\bDDE(AUTO)?\b[^}]*\}"),
    ("include_field", r"(?is)\{\\field\b.*?\\fldinst\b[^}]*\\(INCLUDEPICTURE|INCLUDETEXT)\b[^}]*\}"),
    ("hyperlink_auto", r"(?is)\{\\field\b.*?\\fldinst\b[^}]*HYPERLINK[^}]*\\o\b[^}]*\}"),
    ("pict", r"(?is)\\pict\b.*?\}"),
    ("field", r"(?is)\{\\field\b.*?\}"),
)
RTF_FULL_WORDS = r"(?is)\\(objclass|shp|shpinst|field|pict|blipuid)\b"
PDF_STRIP_KEYS = (
    "/AA", "/OpenAction", "/JS", "/JavaScript", "/Launch", "/SubmitForm", "/ImportData", "/RichMedia",
    "/RichMediaContent",
)
PDF_STRIP_ACTIONS = ("/JavaScript", "/Launch", "/SubmitForm", "/ImportData")
PDF_CATALOG_KEYS = (
    "/OpenAction", "/AA", "/Names", "/AcroForm", "/Outlines", "/PageLabels", "/Annots", "/RichMediaContent",
    "/ViewerPreferences", "/Metadata", "/Info", "/JS", "/JavaScript",
)
PDF_FORM_KEYS = ("XFA", "JS", "JavaScript", "AA", "NeedAppearances", "Fields")
OOXML_DROP_FOLDERS = ("/embeddings/", "/externallinks/", "/webextensions/", "/activex/", "/customxml/")
OOXML_DROP_NAMES = ("/comments", "trackchanges")
EXTERNAL_KINDS = ("/externallink", "/hyperlink")
OVERRIDE_KINDS = ("vba", "activex", "webextension")
OVERRIDE_PARTS = ("/activex/", "/webextensions/", "/externallinks/", "/customxml/", "/comments", "trackchanges")
OOXML_DROP_PROPS = ("docprops/core.xml", "docprops/app.xml", "docprops/custom.xml")
UNSAFE_SCHEMES = ("file:", "javascript:", "vbscript:", "data:")
OOXML_DROP_ELEMENTS = (
    "externalLink", "hyperlink", "hyperlinks", "webExtensions", "taskpane", "taskpanes", "attachedTemplate",
    "OLEObject", "oleObject", "object", "embeddedObject", "control", "ActiveX",
)

# --- Fixed values: scrub vocabulary -------------------------------------------------------------------------
SCRUB_SEEDS = (
    "javascript", "/js", "/javascript", "openaction", "submitform", "launch", "gotoR", "named", "action",
    "richmedia", "embeddedfile", "embeddedfiles", "acroform", "xfa", "needappearances",
    "doc.exportdataobject", "util.printf", "app.launchurl", "this.submitform", "geturl",
    "macro", "vba", "vbaproject", "ole", "activex", "dde", "ddeauto", "includepicture", "includetext",
    "hyperlink", "attachedtemplate",
    "http://", "https://", "javascript:", "file:", "data:", "ftp://", "smb://",
    "cmd", "cmd.exe", "powershell", "powershell.exe", "wscript", "wscript.exe", "cscript", "cscript.exe",
    "mshta", "mshta.exe", "regsvr32", "regsvr32.exe", "rundll32", "rundll32.exe", "bitsadmin", "certutil",
    "curl", "wget", "ftp", "tftp", "schtasks", "at.exe", "whoami", "net user", "net group",
    "base64", "eval", "fromcharcode", "unescape",
    ".exe", ".ps1", ".vbs", ".js", ".jse", ".bat", ".cmd", ".hta", ".dll",
)
SCRUB_FAMILIES = (
    "dropper", "payload", "beacon", "c2", "shellcode", "maldoc", "phish", "obfuscate", "decode",
    "invoke-expression", "iex", "downloadstring", "add-type", "new-object system.net.webclient",
    "start-process", "write-host", "set-mppreference", "amsienable",
)
# seeds that only the PDF vocabulary has
SCRUB_PDF_ONLY = ("doc.exportdataobject", "util.printf", "app.launchurl", "this.submitform", "geturl")
SCRUB_LEET = {
    "a": ("a", "4", "@"), "e": ("e", "3"), "i": ("i", "1", "!"),
    "o": ("o", "0"), "s": ("s", "5", "$"), "t": ("t", "7"),
}
#: What stands before and after a word in its path forms.
SCRUB_PATH_FORMS = (("", ""), ("/", ""), ("\\", ""), ("", "/"), ("", "\\"), ("/", "/"), ("\\", "\\"))
SCRUB_LEET_CAP = 8
SCRUB_SEPARATORS = ("", ".", "_", "-", "\u200b")
SCRUB_PREFIXES = ("", "/", "\\")
SCRUB_SUFFIXES = ("", "()", ":", ";", "'", '"')
SCRUB_TLDS = ("com", "net", "org", "io", "ru", "cn", "xyz")
SCRUB_EXTS = (
    ".exe", ".ps1", ".vbs", ".js", ".jse", ".bat", ".cmd", ".hta", ".dll", ".scr", ".com", ".pif", ".lnk",
)
SCRUB_WEB_EXTS = (".php", ".asp", ".aspx", ".jsp")
