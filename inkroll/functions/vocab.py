"""Word lists of the rules. Results depend on each word."""

# Words of organisation names.
ORG_KEYWORDS = (
    "academy administration agency association biology center centre centro chemistry clinic collaboration collaboratory college company consortium corporation department dept division engineering faculty foundation gmbh group "
    "hospital inc institut institute institution lab laboratoire laboratories laboratory labs llc ltd mathematics medicine ministry observatory physics program programme project research sa school science sciences society srl team "
    "unit universidad universitat university université zentrum"
).split()
# Phrases of organisation names, matched as substrings.
ORG_PHRASES = [
    "center for", "centre for", "cern", "cnrs", "department of", "faculty of", "institute of", "max planck", "nasa", "national laboratory", "research group", "school of", "the collaboration", "the consortium", "university of", "working group",
]
# Connecting words.
CONNECTORS = "and at by da das de del della den der di dos du for in la le of on ten ter the van von with".split()
# Particles of family names.
PARTICLES = "al bin da das de del della den der di dos du el ibn la le ten ter van von".split()
# Words of collaborations and groups.
COLLABORATION = "collaboration collaborations consortium experiment group project survey team working".split()

# What counts as white space, 29 code points.
WS = "[\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
# Punctuation stripped from the ends of a token, and of a candidate.
TOKEN_TRIM = ".,;:()[]{}<>\"“”‘’"
CANDIDATE_TRIM = " .;:-"
