"""Fixed word lists, patterns and messages, and the lexicon type that the router takes.

All of it is data that results depend on; other lexicons can be passed wherever one is used.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: intents and their aliases -------------------------------------------------------
INTENTS = (
    "Emergency_Triage",
    "Symptom_Information",
    "Disease_Information",
    "Facility_Locator",
    "Provider_Locator",
    "Appointment_Booking",
    "Medication_Information",
    "Vaccine_Information",
    "Test_Diagnostics",
    "Treatment_Procedure",
    "Cost_Insurance",
    "General_Health_Education",
    "Non_Medical",
    "Unclear",
)
INTENT_ALIASES = {
    "Emergency": "Emergency_Triage",
    "Emergency Triage": "Emergency_Triage",
    "Medical_Emergency": "Emergency_Triage",
    "Medical Emergency": "Emergency_Triage",
    "NonMedical": "Non_Medical",
    "Non-Medical": "Non_Medical",
    "Non Medical": "Non_Medical",
}

# ---- fixed values: the router's lexicon ------------------------------------------------------------
SOCIAL_PHRASES = ("hi", "hello", "hey", "thanks", "thank you", "bye", "goodbye")
EMERGENCY_TERMS = (
    "emergency",
    "cannot breathe",
    "can't breathe",
    "difficulty breathing",
    "shortness of breath",
    "severe chest pain",
    "chest pain",
    "unconscious",
    "stroke",
    "seizure",
    "severe bleeding",
    "poisoning",
    "overdose",
    "suicide",
    "suicidal",
    "anaphylaxis",
    "severe allergic",
)
INTENT_TERMS = (
    ("Facility_Locator", ("hospital", "hospitals", "clinic", "clinics", "medical center", "health centre", "health center")),
    ("Provider_Locator", ("doctor", "doctors", "specialist", "consultant", "physician", "surgeon")),
    ("Appointment_Booking", ("appointment", "booking", "book", "schedule")),
    ("Cost_Insurance", ("cost", "price", "fee", "insurance", "claim")),
    ("Medication_Information", ("medicine", "medication", "drug", "tablet", "panadol", "paracetamol", "dose", "dosage")),
    ("Vaccine_Information", ("vaccine", "vaccination", "immunization", "jab")),
    ("Test_Diagnostics", ("test", "diagnostic", "diagnosis", "scan", "x-ray", "blood test", "lab report")),
    ("Treatment_Procedure", ("treatment", "procedure", "surgery", "operation", "physiotherapy", "therapy")),
    ("Symptom_Information", ("symptom", "symptoms", "fever", "cough", "pain", "rash", "vomiting", "diarrhea")),
    ("Disease_Information", ("disease", "condition", "common cold", "dengue", "diabetes", "hypertension", "asthma", "covid")),
    ("General_Health_Education", ("health", "prevention", "nutrition", "exercise", "diet")),
)
STOP_WORDS = ("want", "details", "about", "know", "with", "from", "please")
CURRENT_TERMS = ("recent", "latest", "current", "today", "now", "outbreak", "epidemic", "advisory", "this week", "this month")

# ---- fixed values: prompt-injection signs ----------------------------------------------------------
INJECTION_TOKENS = ("<|im_start|>", "<|im_end|>", "<|system|>", "[INST]", "<<SYS>>")
INJECTION_PATTERNS = (
    ("instruction_override", r"ignore.{0,20}(previous|all).{0,20}instructions?"),
    ("role_hijack", r"you are now|act as a|pretend to be"),
    ("prompt_extraction", r"show.{0,15}system.{0,15}prompt"),
)

# ---- fixed values: localized messages --------------------------------------------------------------
MESSAGES = {
    "instruction": {
        "si": "Reply in Sinhala using Sinhala script.",
        "ta": "Reply in Tamil using Tamil script.",
        "en": "Reply in English.",
    },
    "clarify": {
        "si": "කරුණාකර ඔබගේ සෞඛ්‍ය ගැටලුව හෝ අවශ්‍ය තොරතුර තව ටිකක් පැහැදිලි කරන්න.",
        "ta": "தயவுசெய்து உங்கள் உடல்நலக் கேள்வி அல்லது தேவையை இன்னும் கொஞ்சம் தெளிவாகச் சொல்லுங்கள்.",
        "en": "Could you clarify what health information you need?",
    },
    "no_context": {
        "si": "මෙම ප්‍රශ්නයට විශ්වාසදායක මූලාශ්‍ර තොරතුරු ප්‍රමාණවත් ලෙස සොයාගත නොහැකි විය. කරුණාකර සුදුසුකම් ලත් සෞඛ්‍ය වෘත්තිකයෙකුගෙන් හෝ නිල සෞඛ්‍ය සේවාවකින් උපදෙස් ලබාගන්න.",
        "ta": "இந்த கேள்விக்கு போதுமான நம்பகமான ஆதாரத் தகவலை கண்டறிய முடியவில்லை. தயவுசெய்து தகுதியான சுகாதார நிபுணர் அல்லது அதிகாரப்பூர்வ சுகாதார சேவையிடம் ஆலோசனை பெறவும்.",
        "en": "I could not find enough reliable source material to answer that safely. Please consult a qualified healthcare professional or an official health service for guidance.",
    },
    "error_llm": {
        "si": "දැන් ඔබගේ ඉල්ලීම සැකසීමට මට අපහසුයි. ටික වේලාවකින් නැවත උත්සාහ කරන්න.",
        "ta": "உங்கள் கோரிக்கையை தற்போது செயலாக்க முடியவில்லை. சிறிது நேரத்தில் மீண்டும் முயற்சிக்கவும்.",
        "en": "I'm having trouble processing your request right now. Please try again in a moment.",
    },
    "error_retrieval": {
        "si": "අදාළ තොරතුරු ලබාගැනීමට මට නොහැකි විය. කරුණාකර ඔබගේ ප්‍රශ්නය වෙනත් ආකාරයකින් නැවත යොමු කරන්න.",
        "ta": "தொடர்புடைய தகவலை பெற முடியவில்லை. தயவுசெய்து உங்கள் கேள்வியை வேறு விதமாக மீண்டும் கேளுங்கள்.",
        "en": "I couldn't retrieve the relevant information. Please try rephrasing your question.",
    },
    "error_general": {
        "si": "අපේක්ෂා නොකළ දෝෂයක් ඇතිවිය. කරුණාකර නැවත උත්සාහ කරන්න.",
        "ta": "எதிர்பாராத பிழை ஒன்று ஏற்பட்டது. தயவுசெய்து மீண்டும் முயற்சிக்கவும்.",
        "en": "An unexpected error occurred. Please try again.",
    },
    "disclaimer": {
        "si": "\n\n⚕️ වෛද්‍ය ප්‍රකාශනය: මෙම තොරතුරු අධ්‍යාපනික අරමුණු සඳහා පමණක් වන අතර වෛද්‍ය උපදෙස් ලෙස නොසලකන්න. රෝග ලක්ෂණ, නිරෝගීභාවය, හෝ ප්‍රතිකාර සඳහා සුදුසුකම් ලත් සෞඛ්‍ය වෘත්තිකයෙකුගෙන් උපදෙස් ලබාගන්න.",
        "ta": "\n\n⚕️ மருத்துவ அறிவிப்பு: இந்த தகவல் கல்வி நோக்கத்திற்காக மட்டுமே வழங்கப்படுகிறது; இதை மருத்துவ ஆலோசனையாக கருத வேண்டாம். உடல்நலக் கவலைகள், நோயறிதல் அல்லது சிகிச்சைக்காக தகுதியான சுகாதார நிபுணரை அணுகவும்.",
    },
}


@dataclass(frozen=True)
class Lexicon:
    """What the deterministic router looks for; all terms in lower case."""

    social: tuple[str, ...] = SOCIAL_PHRASES
    emergency: tuple[str, ...] = EMERGENCY_TERMS
    intents: tuple[tuple[str, tuple[str, ...]], ...] = INTENT_TERMS
    stop_words: tuple[str, ...] = STOP_WORDS
    current: tuple[str, ...] = CURRENT_TERMS
