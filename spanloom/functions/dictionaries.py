"""Word lists, patterns and policies that recognizers use. They are small and don't grow with the data."""

from __future__ import annotations

from typing import NamedTuple

# Terms by category.
DIAGNOSES = [
    "alzheimer", "amyotrophic lateral sclerosis", "anemia", "arthritis", "asthma", "atrial fibrillation", "bronchitis", "cancer",
    "cerebrovascular accident", "cholera", "chronic kidney disease", "cirrhosis", "copd", "coronary artery disease", "deep vein thrombosis", "dengue",
    "diabetes", "diabetic neuropathy", "diabetic retinopathy", "eczema", "encephalitis", "epilepsy", "fibromyalgia", "gestational diabetes", "gout",
    "heart failure", "hepatitis", "hiv", "hypertension", "hyperthyroidism", "hypothyroidism", "influenza", "leukemia", "lupus", "lymphoma", "malaria",
    "melanoma", "meningitis", "migraine", "multiple sclerosis", "myocardial infarction", "obesity", "osteoporosis", "pancreatitis", "parkinson",
    "pneumonia", "psoriasis", "pulmonary embolism", "rheumatoid arthritis", "sarcoma", "sepsis", "stroke", "tuberculosis", "type 1 diabetes",
    "type 2 diabetes", "typhoid",
]
MEDICATIONS = [
    "acetaminophen", "albuterol", "amlodipine", "amoxicillin", "aspirin", "atorvastatin", "azithromycin", "ciprofloxacin", "clopidogrel", "codeine",
    "dexamethasone", "diazepam", "doxycycline", "empagliflozin", "escitalopram", "fentanyl", "fluoxetine", "fluticasone", "furosemide", "gabapentin",
    "heparin", "hydrochlorothiazide", "ibuprofen", "insulin", "levothyroxine", "lisinopril", "lorazepam", "losartan", "metformin", "metoclopramide",
    "metoprolol", "morphine", "naproxen", "omeprazole", "ondansetron", "pantoprazole", "paracetamol", "prednisone", "ranitidine", "rosuvastatin",
    "salbutamol", "sertraline", "simvastatin", "sitagliptin", "tramadol", "warfarin",
]
PROCEDURES = [
    "amputation", "angioplasty", "appendectomy", "arthroscopy", "biopsy", "blood test", "blood transfusion", "bone marrow biopsy", "bronchoscopy",
    "bypass", "c-section", "catheterization", "cesarean section", "chemotherapy", "cholecystectomy", "colonoscopy", "covid test", "ct scan",
    "dialysis", "ecg", "echocardiogram", "eeg", "ekg", "electrocardiogram", "endoscopy", "hysterectomy", "intubation", "laparoscopy",
    "lumbar puncture", "mammography", "mastectomy", "mri", "pap smear", "pcr test", "radiotherapy", "surgery", "transplant", "ultrasound",
    "urine test", "vasectomy", "ventilation", "x-ray",
]
FACILITIES = [
    "cardiology", "casualty", "clinic", "department", "dermatology", "dispensary", "emergency", "ent", "gynecology", "health center", "health centre",
    "hospital", "icu", "lab", "laboratory", "maternity", "medical center", "medical centre", "neurology", "nursing home", "oncology", "opd",
    "ophthalmology", "orthopaedic", "orthopedic", "ot", "pathology", "pediatric", "pharmacy", "polyclinic", "radiology", "urology", "ward",
]
GENDERS = [
    "boy", "f", "female", "girl", "intersex", "m", "male", "man", "non-binary", "nonbinary", "transgender", "woman",
]
SURNAMES = [
    "agarwal", "banerjee", "bhat", "bose", "chakraborty", "chatterjee", "chopra", "choudhury", "das", "dasgupta", "dey", "dubey", "ghosh", "gupta",
    "hegde", "iyer", "jain", "joshi", "kapoor", "kaur", "krishnamurthy", "kulkarni", "kumar", "malhotra", "mehta", "menon", "mishra", "mukherjee",
    "naidu", "nair", "pandey", "patel", "pillai", "rajan", "rao", "reddy", "roy", "saxena", "sen", "shah", "sharma", "singh", "srinivasan",
    "subramaniam", "sundaram", "thakur", "tiwari", "trivedi", "venkatesh", "verma", "yadav",
]

# Policy, thresholds and label maps.
MASK_TYPES = [
    "PERSON", "DATE_TIME", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "LOCATION", "IP_ADDRESS", "URL", "US_DRIVER_LICENSE", "MEDICAL_LICENSE", "NRP",
    "IBAN_CODE", "CREDIT_CARD", "US_PASSPORT", "US_BANK_NUMBER", "DEVICE_ID",
]
KEEP_TYPES = [
    "DIAGNOSIS", "MEDICATION", "PROCEDURE", "MEDICAL_CONDITION", "GENDER", "AGE",
]
MEDICAL_TYPES = [
    "MEDICAL_CONDITION", "DIAGNOSIS", "MEDICATION", "PROCEDURE",
]
SCORE_THRESHOLD, SAFETY_THRESHOLD, AGE_LIMIT = 0.35, 0.98, 89
KINSHIP_WORDS, KINSHIP_BOOST = 5, 0.15
CONTEXT_WORDS, CONTEXT_BOOST, CONTEXT_FLOOR = 5, 0.35, 0.4
BIO_STEMS = {
    "PERSON": "Name", "AGE": "Age", "PHONE_NUMBER": "Phone", "EMAIL_ADDRESS": "Email", "LOCATION": "Address", "DATE_TIME": "Date", "ORGANIZATION": "Organization", "NRP": "Organization",
    "URL": "Other", "IP_ADDRESS": "Other", "DEVICE_ID": "HospitalID", "MEDICAL_LICENSE": "HospitalID", "US_SSN": "HospitalID", "US_DRIVER_LICENSE": "HospitalID", "UK_NHS": "HospitalID",
    "IBAN_CODE": "HospitalID", "CREDIT_CARD": "HospitalID", "US_PASSPORT": "HospitalID", "US_BANK_NUMBER": "HospitalID",
}
STEM_ENTITIES = {
    "Name": "PERSON", "DoctorName": "PERSON", "Age": "AGE", "Phone": "PHONE_NUMBER", "Email": "EMAIL_ADDRESS", "Address": "LOCATION", "HospitalID": "DEVICE_ID", "Other": "DEVICE_ID",
    "Date": "DATE_TIME", "Organization": "ORGANIZATION",
}
BIO_LABELS = ["O", *(f"{p}-{s}" for s in ["Name", "Age", "Phone", "Email", "Address", "HospitalID", "Date", "DoctorName", "Organization", "Other"] for p in "BI")]
DOCTOR_WORDS = r"(?i)(Dr\.?|Doctor|Physician|Surgeon|Consultant|Attending|Referred by|Reporting)"
KINSHIP = r"(?i)\b(?:S/O|D/O|W/O|C/O|Son\s+of|Daughter\s+of|Wife\s+of|Care\s+of|Dr\.|Dr|Smt\.|Shri\.|Shri|Sri\.|Sri|Mr\.|Mrs\.|Ms\.)\b"


class Pattern(NamedTuple):
    """A recognizer: a regex that Java and RE2 read alike on ASCII text, what it finds, how sure it is, and the words or phrases (lower case, by
    commas) that make it surer when they stand before a match.

    first: the characters that a match can begin with; needs: a pattern that a text with a match has. Both only spare time.
    """

    name: str
    entity: str
    regex: str
    score: float
    context: str = ""
    first: str = ""
    needs: str = ""


def any_of(terms: list[str]) -> str:
    """A pattern of any of these terms, the longest that fits: common beginnings stand once, so a text's word is held against a few letters instead
    of each term."""
    ends, after = "" in terms, {}
    for t in terms:
        if t:
            after.setdefault(t[0], []).append(t[1:])
    parts = ["".join("\\" + c if c in ".+" else c for c in head) + any_of(tails) for head, tails in sorted(after.items())]
    if not parts:
        return ""
    if len(parts) == 1 and not ends:
        return parts[0]
    return f"(?:{'|'.join(parts)})" + ("?" if ends else "")


def _firsts(terms: list[str]) -> str:
    letters = sorted({t[0] for t in terms})
    return "".join(letters) + "".join(letters).upper()


def _terms(terms: list[str]) -> str:
    """Whole words of a list."""
    return rf"(?i)\b{any_of(terms)}\b"


_PERSON_CONTEXT = "name,patient,s/o,d/o,w/o,c/o,son of,daughter of,wife of,shri,smt"

#: Age as written in notes; the strict form of the recognizer matches nothing.
AGE = r"(?i)(?:age[d]?\s*[:=]?\s*[0-9]{1,3}|[0-9]{1,3}\s*(?:years?\s*old|yo|y/o|yrs))"

#: Any term of the medical dictionaries between characters that are no letters or digits; where `\\b` finds one, this does too.
MEDICAL = rf"(?i)(?=[{_firsts(DIAGNOSES + MEDICATIONS + PROCEDURES + FACILITIES)}])(?<![\p{{L}}\p{{N}}]){any_of(DIAGNOSES + MEDICATIONS + PROCEDURES + FACILITIES)}(?![\p{{L}}\p{{N}}])"

PATTERNS = [
    Pattern("medical_term", "MEDICAL_CONDITION", _terms(DIAGNOSES + MEDICATIONS + PROCEDURES), 0.95, "diagnosis,condition,disease,medication,drug,prescription,procedure,treatment", _firsts(DIAGNOSES + MEDICATIONS + PROCEDURES), MEDICAL),
    Pattern("gender_term", "GENDER", _terms(GENDERS), 0.90, "gender,sex", _firsts(GENDERS)),
    Pattern("age_expr", "AGE", AGE, 0.90, "age,years old,yo", "aA0-9", "[0-9]"),
    Pattern("device_udi", "DEVICE_ID", r"\b[0-9]{2}\-[0-9]{5,}\b", 0.60, "device,serial,udi,implant", "0-9", "[0-9]"),
    Pattern("device_serial", "DEVICE_ID", r"(?i)\b[A-Z]{2,3}\-?[0-9]{6,}\b", 0.55, "device,serial,udi,implant", "A-Za-z", "[0-9]"),
    Pattern("mrn", "MEDICAL_LICENSE", r"(?i)\b(?:MRN|MR#|Medical Record)\s*[:#]?\s*[0-9]{5,}\b", 0.80, "record,license,npi,mrn", "mM", "[0-9]"),
    Pattern("npi", "MEDICAL_LICENSE", r"(?i)\b(?:NPI)\s*[:#]?\s*[0-9]{10}\b", 0.85, "record,license,npi,mrn", "nN", "[0-9]"),
    Pattern("indian_surname", "PERSON", _terms(SURNAMES), 0.85, _PERSON_CONTEXT, _firsts(SURNAMES)),
    Pattern("aadhaar", "PERSON", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", 0.90, _PERSON_CONTEXT, "0-9", "[0-9]"),
    Pattern("pan_card", "PERSON", r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.90, _PERSON_CONTEXT, "A-Za-z", "[0-9]"),
    Pattern("indian_phone", "PERSON", r"(?:\+91[\s-]?|0)[0-9]{10}\b", 0.80, _PERSON_CONTEXT, "+0", "[0-9]"),
    Pattern("medical_facility", "MEDICAL_CONDITION", _terms(FACILITIES), 0.93, "hospital,clinic,medical,health,department", _firsts(FACILITIES), MEDICAL),
    Pattern("ssn_broad", "US_SSN", r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b", 0.75, "ssn,social,security,ss#,ss #", "0-9", "[0-9]"),
]

_GROUPS = [
    "american", "arab", "asian", "australian", "british", "buddhist", "canadian", "catholic", "chinese", "christian", "european", "french", "german", "hindu", "indian", "italian",
    "japanese", "jewish", "muslim", "nepali", "pakistani", "parsi", "russian", "sikh", "spanish",
]

#: General recognizers, each with the check that a match must pass. A passed check makes a match certain; the others are as sure as public
#: recognizers of these kinds say. Addresses, organizations and groups of people are rules in place of a statistical model.
GENERAL = {
    "email": (Pattern("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, "email", "", "@"), None),
    "ip": (Pattern("ip", "IP_ADDRESS", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.6, "ip,ipv4", "0-9", "[0-9]"), "octets"),
    "ipv6": (Pattern("ipv6", "IP_ADDRESS", r"\b(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})\b", 0.6, "ip,ipv6", "0-9A-Fa-f", ":"), "groups"),
    "card": (Pattern("card", "CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){12,18}", 1.0, "credit,card,visa,mastercard", "0-9", "[0-9]"), "luhn"),
    "url": (Pattern("url", "URL", r"https?://[A-Za-z0-9./?=&_%#:-]+", 0.6, "url,website,link", "h", "://"), None),
    "phone": (Pattern("phone", "PHONE_NUMBER", r"\+[0-9]{1,3}[ (-][0-9() -]{6,16}[0-9]", 0.4, "phone,number,telephone,cell,mobile,call", "+", "[0-9]"), "nine"),
    "iban": (Pattern("iban", "IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 1.0, "iban,bank,transaction", "A-Z", "[0-9]"), "mod97"),
    "passport": (Pattern("passport", "US_PASSPORT", r"\b[0-9]{9}\b", 0.05, "passport,travel,document", "0-9", "[0-9]"), None),
    "bank": (Pattern("bank", "US_BANK_NUMBER", r"\b[0-9]{8,17}\b", 0.05, "check,account,acct,bank,save,debit", "0-9", "[0-9]"), None),
    "driver": (Pattern("driver", "US_DRIVER_LICENSE", r"\b[A-Z][0-9]{6,8}\b", 0.3, "driver,license,permit,lic,identification", "A-Z", "[0-9]"), None),
    "nhs": (Pattern("nhs", "UK_NHS", r"\b[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}\b", 1.0, "nhs,national health service", "0-9", "[0-9]"), "mod11"),
    "dea": (Pattern("dea", "MEDICAL_LICENSE", r"\b[ABCDEFGHJKLMPRSTUXabcdefghjklmprstux][A-Za-z9][0-9]{7}\b", 1.0, "medical,certificate,dea", "A-Za-z", "[0-9]"), "dea"),
    "date": (Pattern("date", "DATE_TIME", r"\b(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{2,4})\b", 0.6, "date,birthday", "0-9", "[0-9]"), None),
    "address": (Pattern("address", "LOCATION", r"\b[0-9]{1,5},? [A-Z][a-z]+(?: [A-Z][a-z]+){0,2} (?:Street|Road|Avenue|Lane|Nagar|Marg|Colony|Square)\b", 0.85, "", "0-9", "[0-9]"), None),
    "organization": (Pattern("organization", "ORGANIZATION", r"\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,3} (?:Ltd|Inc|LLC|Corp|University|Foundation|Trust|Insurance)\b", 0.85, "", "A-Z"), None),
    "group": (Pattern("group", "NRP", _terms(_GROUPS), 0.85, "", _firsts(_GROUPS)), None),
}

#: The second source: dictionaries searched for whole terms, every occurrence.
GAZETTEERS = [(DIAGNOSES, "DIAGNOSIS", 0.92), (MEDICATIONS, "MEDICATION", 0.90), (PROCEDURES, "PROCEDURE", 0.88), (FACILITIES, "MEDICAL_CONDITION", 0.93)]
