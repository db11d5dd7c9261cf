"""Stop-word lists used by ``tokenize_nostop`` and the type-token redundancy.

The reference relies on a tagger's built-in list that is not part of it; these
short lists are our own stated rule.  The oracle SQL embeds the same lists, so
both engines drop the same words.
"""

# Stop words per language code (lower case).
STOP_WORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
           "has", "have", "he", "her", "his", "in", "is", "it", "its", "not", "of",
           "on", "or", "she", "that", "the", "their", "there", "they", "this", "to",
           "was", "were", "which", "will", "with"],
    "fr": ["au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en",
           "est", "et", "il", "la", "le", "les", "leur", "lui", "ne", "nous", "on",
           "ou", "par", "pas", "pour", "qui", "que", "sur", "un", "une", "vous"],
    "de": ["als", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der",
           "des", "die", "ein", "eine", "einen", "er", "es", "für", "ich", "ist",
           "mit", "nicht", "sich", "sie", "sind", "und", "von", "war", "wir", "zu"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo",
           "los", "más", "no", "para", "pero", "por", "que", "se", "su", "sus", "un",
           "una", "y"],
    "nl": ["aan", "als", "bij", "dat", "de", "den", "der", "die", "dit", "een", "en",
           "het", "hij", "in", "is", "met", "niet", "of", "op", "te", "van", "voor",
           "was", "wat", "ze", "zich", "zijn"],
}


def all_stop_words() -> list[str]:
    """Union of every list, sorted: the default when a row has no language."""
    return sorted({w for ws in STOP_WORDS.values() for w in ws})
