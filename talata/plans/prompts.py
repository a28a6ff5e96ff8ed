"""Prompt texts of the tasks, English and Filipino. Tasks must carry these texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AFFIX_MCQ = {
    "prefix": ('Which option has the prefix "{prefix}-"?', 'Alin sa mga sumusunod ang may laping "{prefix}-"?'),
    "suffix": ('Which option has the suffix "-{suffix}"?', 'Alin sa mga sumusunod ang may laping "-{suffix}"?'),
    "infix": ('Which option has the infix "-{infix}-"?', 'Alin sa mga sumusunod ang may laping "-{infix}-"?'),
    "circumfix": ('Which option has the circumfix "{prefix}-" and "-{suffix}"?', 'Alin sa mga sumusunod ang may laping "{prefix}-" at "-{suffix}"?'),
}
AFFIX_GEN = {
    "prefix": ('Inflect the word "{root}" to use the prefix "{prefix}-".', 'Lapian ng "{prefix}-" ang salitang "{root}".'),
    "suffix": ('Inflect the word "{root}" to use the suffix "-{suffix}".', 'Lapian ng "-{suffix}" ang salitang "{root}".'),
    "infix": ('Inflect the word "{root}" to use the infix "-{infix}-".', 'Lapian ng "-{infix}-" ang salitang "{root}".'),
    "circumfix": ('Inflect the word "{root}" to use the circumfix "{prefix}-" and "-{suffix}".', 'Lapian ng "{prefix}-" at "-{suffix}" ang salitang "{root}".'),
}
AFFIX_ID_MCQ = ('Which option is the affix used to inflect the word "{correct}"?', 'Alin sa sumusunod ang lapi na ginamit sa salitang "{correct}"?')
AFFIX_ID_GEN = ('What is the affix used to inflect the word "{correct}"?', 'Ano ang lapi na ginamit sa salitang "{correct}"?')

SPELLING_MCQ = ('Which option spells out "{normalized_word}"?', 'Alin sa sumusunod ang nagbabaybay sa "{normalized_word}"?')
SPELLING_GEN = ('Spell out the word "{normalized_word}".', 'Baybayin ang salitang "{normalized_word}".')
CHARACTER_GEN = ('How many "{character}"s are in "{normalized_word}"?', 'Ilang "{character}" ang mayroon sa "{normalized_word}".')
LENGTH_GEN = ('How many characters are in the "{normalized_word}"?', 'Ilan ang titik sa "{normalized_word}"?')
DIACRITIC_GEN = ('How many diacritics are in "{word}"?', 'Ilang titik ang mayroong tuldik sa "{word}".')
UPPERCASE_GEN = ('How many uppercase characters are in "{normalized_word}"?', 'Ilang malaking titik ang mayroon sa "{normalized_word}".')
CHAR_EXACTLY = ('Which option contains exactly {target_count} "{char}"s?', 'Alin sa sumusunod ang naglalaman ng eksaktong {target_count} "{char}"?')
CHAR_MOST = ('Which option contains the most number of "{char}"?', 'Alin sa sumusunod ang naglalaman ng pinakamaraming "{char}"?')
CHAR_LEAST = ('Which option contains the least number of "{char}"?', 'Alin sa sumusunod ang naglalaman ng pinakakaunting "{char}"?')
LENGTH_EXACTLY = ("Which option contains exactly {target_length} characters?", "Alin sa sumusunod ang naglalaman ng eksaktong {target_length} titik?")
LENGTH_MOST = ("Which option contains the most number of characters?", "Alin sa sumusunod ang naglalaman ng pinakamaraming titik?")
LENGTH_LEAST = ("Which option contains the least number of characters?", "Alin sa sumusunod ang naglalaman ng pinakakaunting titik?")

MANIPULATION_MCQ = {
    "deletion": ('Which option correctly removes every "{char_to_delete}" in "{normalized_word}"?', 'Alin sa sumusunod ang nagtatanggal ng bawat "{char_to_delete}" sa "{normalized_word}"?'),
    "insertion": ('Which option correctly puts "{char_to_insert}" after every "{preceding_char}" in "{normalized_word}"?', 'Alin sa sumusunod ang naglalagay ng "{char_to_insert}" pagkatapos ng bawat "{preceding_char}" sa "{normalized_word}"?'),
    "substitution": (
        'Which option correctly replaces every "{char_to_replace}" with "{char_to_substitute}" in "{normalized_word}"?',
        'Alin sa sumusunod ang pumapalit sa bawat "{char_to_replace}" gamit ng "{char_to_substitute}" sa "{normalized_word}"?',
    ),
    "permutation": (
        'Which option correctly swaps every "{char1}" with "{char2}" and vice versa in "{normalized_word}"?',
        'Alin sa sumusunod ang pumapalit sa bawat "{char1}" gamit ng "{char2}" at ang kabaligtarang din nito sa "{normalized_word}"?',
    ),
    "duplication": ('Which option correctly duplicates every "{char_to_duplicate}" once in "{normalized_word}"?', 'Alin sa sumusunod ang umuulit sa bawat "{char_to_duplicate}" nang isang beses sa "{normalized_word}"?'),
    "uppercasing": ('Which option correctly changes "{normalized_word}" to all uppercase?', 'Alin sa sumusunod ang ginagawang malaki ang lahat ng titik sa "{normalized_word}"?'),
    "lowercasing": ('Which option correctly changes "{normalized_word}" to all lowercase?', 'Alin sa sumusunod ang ginagawang maliit ang lahat ng titik sa "{normalized_word}"?'),
    "diacritic_normalization": ('Which option correctly normalizes diacritics from "{word}"?', 'Alin sa sumusunod ang nagtatanggal ng mga tuldik sa "{word}"?'),
}
MANIPULATION_GEN = {
    "deletion": ('Remove every "{char_to_delete}" in "{normalized_word}".', 'Tanggalin ang bawat "{char_to_delete}" sa "{normalized_word}".'),
    "insertion": ('Put a "{char_to_insert}" after every "{preceding_char}" in "{normalized_word}"', 'Maglagay ng "{char_to_insert}" pagkatapos ng bawat "{preceding_char}" sa "{normalized_word}"'),
    "substitution": ('Replace every "{char_to_replace}" with "{char_to_substitute}" in "{normalized_word}".', 'Palitan ang bawat "{char_to_replace}" gamit ng "{char_to_substitute}" sa "{normalized_word}".'),
    "permutation": ('Swap every "{char1}" with "{char2}" in "{normalized_word}".', 'Palitan ang bawat "{char1}" gamit ng "{char2}" at ang kabaligtarang din nito sa "{normalized_word}".'),
    "duplication": ('Duplicate every "{char_to_duplicate}" once in "{normalized_word}".', 'Ulitin ang bawat "{char_to_duplicate}" nang isang beses sa "{normalized_word}".'),
    "uppercasing": ('Change "{normalized_word}" into uppercase.', 'Gawing malaki ang lahat ng titik sa "{normalized_word}".'),
    "lowercasing": ('Change "{normalized_word}" into lowercase.', 'Gawing maliit ang lahat ng titik sa "{normalized_word}".'),
    "diacritic_normalization": ('Normalize the diacritics from "{word}".', 'Tanggalin ang lahat ng mga tuldik sa "{word}".'),
}

STRESS = ('What is the stress type of the last syllable in "{word}"?', 'Ano ang uri ng diin ng huling pantig sa "{word}"?')
REDUPLICATION_MCQ = ("Which word has CV-reduplication (first consonant-vowel repeated)?", "Alin ang may uulit-pantig (inuulit ang unang katinig-patinig)?")
REDUPLICATION_GEN = ('What is the reduplicated syllable in "{normalized_word}"?', 'Ano ang inuulit na pantig sa "{normalized_word}"?')
SYLLABLES = ('How many syllables in "{normalized_word}"?', 'Ilang pantig ang "{normalized_word}"?')

STRESSED_SYLLABLE = ('Which syllable is stressed in the word "{word}" in this context: "{context}"?', 'Aling pantig ang may diin sa salitang "{word}" sa pangungusap na: "{context}"?')
STRESS_KIND = ('What type of stress does the word "{word}" have in this context: "{context}"?', 'Anong klase ng diin ang meron sa salitang "{word}" sa pangungusap na: "{context}"?')
ACCENT_MARKS = (
    'How should the word "{word}" be written with proper accent marks in this context: "{context}"?',
    'Paano isusulat ang salitang "{word}" na may tamang marka ng diin sa pangungusap na: "{context}"?',
)

LEVELS = {
    "character_identification": ("What is the {ordinal} character in '{word}'?", "Ano ang ika-{position} karakter sa salitang '{word}'?"),
    "character_counting": ("How many '{char}' characters are in '{word}'?", "Ilang '{char}' ang nasa salitang '{word}'?"),
    "character_presence": ("Does '{word}' contain the character '{char}'?", "May '{char}' ba sa salitang '{word}'?"),
    "deletion": ("Delete the {ordinal} character from '{word}'.", "Tanggalin ang ika-{position} karakter mula sa salitang '{word}'."),
    "insertion": ("Insert '{char}' at position {position} in '{word}'.", "Isingit ang '{char}' sa ika-{position} posisyon sa salitang '{word}'."),
    "substitution": ("Replace the {ordinal} character in '{word}' with '{char}'.", "Palitan ang ika-{position} karakter sa salitang '{word}' ng '{char}'."),
    "permutation": ("Swap characters at positions {pos1} and {pos2} in '{word}'.", "Palitan ang mga karakter sa posisyon {pos1} at {pos2} sa salitang '{word}'."),
    "affix_identification": ("What is the {affix_type} in '{word}'?", "Ano ang {affix_type} sa salitang '{word}'?"),
    "root_extraction": ("What is the root word of '{word}'?", "Ano ang salitang-ugat ng '{word}'?"),
    "syllable_counting": ("How many syllables are in '{word}'?", "Ilang pantig ang nasa salitang '{word}'?"),
    "affix_removal": ("Remove the {affix_type} from '{word}'.", "Tanggalin ang {affix_type} mula sa salitang '{word}'."),
    "affix_application": ("Add {affix_type} '{affix}' to the root '{root}'.", "Ikabit ang {affix_type} na '{affix}' sa salitang-ugat na '{root}'."),
    "multi_step": ("Extract the root from '{word}', then add {affix_type} '{affix}'.", "Kunin ang ugat mula sa '{word}', pagkatapos ay ikabit ang {affix_type} na '{affix}'."),
}

# Language games: synonyms and question parts.
THE = ["the", "the possible", "the available"]
OPTION = ["word", "", "string", "option", "choice", "option word", "option string"]
OPTIONS = ["options", "choices", "option words", "option strings"]
GAME_OPENINGS = ["Which <OPTION>", "What <OPTION>", "Which of <THE> <OPTIONS>"]
GAME_LISTS = ["<THE> <OPTIONS>:", "<THE> <OPTIONS> are:", "These are <THE> <OPTIONS>:"]
GAMES = {
    "most": "has the most letter '<AUX>'s?",
    "contains": "contains '<AUX>'?",
    "starts": "starts with '<AUX>'?",
    "ends": "ends with '<AUX>'?",
    "longest": "is the longest?",
    "shortest": "is the shortest?",
}


def render(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append((values[name] if name in values else F.col(name)).cast("string"))
    return F.concat(*parts)
