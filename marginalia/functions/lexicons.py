"""Word lists and organisation names."""

from __future__ import annotations

# Acronyms of organisations and their full names, as citations know them.
ORGANIZATIONS = {
    "WHO": ["World Health Organization"],
    "APA": ["American Psychological Association", "American Psychiatric Association"],
    "CDC": ["Centers for Disease Control and Prevention"],
    "NIH": ["National Institutes of Health"],
    "UNESCO": ["United Nations Educational, Scientific and Cultural Organization"],
    "UNICEF": ["United Nations Children's Fund", "United Nations International Children's Emergency Fund"],
    "NASA": ["National Aeronautics and Space Administration"],
    "FDA": ["Food and Drug Administration"],
    "EPA": ["Environmental Protection Agency"],
    "NIMH": ["National Institute of Mental Health"],
    "NIST": ["National Institute of Standards and Technology"],
    "NSF": ["National Science Foundation"],
    "EU": ["European Union"],
    "UN": ["United Nations"],
    "OECD": ["Organisation for Economic Co-operation and Development"],
    "IMF": ["International Monetary Fund"],
    "WTO": ["World Trade Organization"],
    "JASP": ["JASP Team"],
}

# Words that decide whether a name can be an author.
MONTHS = frozenset(
    "january february march april may june july august september october november december"
    " jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
NOT_AUTHORS = frozenset(
    "the this that these those their there where when while which what with from into upon about after before between"
    " through during without within among along across behind beyond under over above below around toward towards against"
    " throughout despite figure table section chapter study research analysis results method discussion conclusion"
    " introduction abstract however therefore furthermore moreover nevertheless although whereas because since unless until".split()
)
CONNECTORS = frozenset(
    "also additionally furthermore moreover besides likewise similarly however nevertheless nonetheless conversely instead"
    " otherwise yet still therefore thus hence consequently accordingly recently previously currently subsequently finally"
    " initially originally eventually meanwhile first second third lastly importantly notably interestingly specifically"
    " indeed clearly obviously certainly particularly especially crucially critically overall generally typically usually"
    " often alternatively".split()
)
NOT_ORG_LEADS = frozenset(
    "see as per via cf eg ie ed eds vol no nos pp fig figs in of for and but compare reviewed supplementary supporting"
    " appendix note notes data panel".split()
)
PLAIN_NOT_AUTHORS = NOT_AUTHORS | frozenset("also like unlike see following including notably specifically particularly especially given except according".split())
ORG_WORDS = (
    "organization association institute agency foundation committee council department bureau board commission center"
    " centre administration service office"
).split()

# Ligatures that stand for letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def organization_names(acronym: str) -> list[str] | None:
    return ORGANIZATIONS.get(acronym.upper())

# Acronyms and full names as reference lists know them. Not a superset of the above.
REFERENCE_ORGANIZATIONS = {
    "WHO": ["World Health Organization"],
    "APA": ["American Psychological Association", "American Psychiatric Association"],
    "CDC": ["Centers for Disease Control and Prevention"],
    "NIH": ["National Institutes of Health"],
    "UNESCO": ["United Nations Educational, Scientific and Cultural Organization"],
    'UNICEF': ["United Nations Children's Fund", "United Nations International Children's Emergency Fund"],
    "NASA": ["National Aeronautics and Space Administration"],
    "FDA": ["Food and Drug Administration"],
    "EPA": ["Environmental Protection Agency"],
    "NIMH": ["National Institute of Mental Health"],
    "NIST": ["National Institute of Standards and Technology"],
    "NSF": ["National Science Foundation"],
    "EU": ["European Union"],
    "UN": ["United Nations"],
    "OECD": ["Organisation for Economic Co-operation and Development"],
    "IMF": ["International Monetary Fund"],
    "WTO": ["World Trade Organization"],
    "ProFAN": ["ProFAN Consortium"],
    "NICE": ["National Institute for Health and Care Excellence"],
    "NHS": ["National Health Service"],
    "IBGE": ["Instituto Brasileiro de Geografia e Estatística"],
    "AAPOR": ["American Association for Public Opinion Research"],
    "US Census Bureau": ["United States Census Bureau"],
    "IACO": ["International Alliance of Carer Organizations"],
    "WWF": ["World Wildlife Fund", "World Wide Fund for Nature"],
    "IUCN": ["International Union for Conservation of Nature"],
    "IPCC": ["Intergovernmental Panel on Climate Change"],
    "UNDP": ["United Nations Development Programme"],
    "FAO": ["Food and Agriculture Organization"],
    "ILO": ["International Labour Organization"],
    "USDA": ["United States Department of Agriculture"],
    "NOAA": ["National Oceanic and Atmospheric Administration"],
    "NRC": ["National Research Council"],
    "NAS": ["National Academy of Sciences"],
    "USGS": ["United States Geological Survey"],
    "DFID": ["Department for International Development"],
    "UNEP": ["United Nations Environment Programme"],
    "UNCTAD": ["United Nations Conference on Trade and Development"],
    "IOM": ["International Organization for Migration"],
    "UNHCR": ["United Nations High Commissioner for Refugees"],
    "UNAIDS": ["Joint United Nations Programme on HIV/AIDS"],
    "NHTSA": ["National Highway Traffic Safety Administration"],
    "SAMHSA": ["Substance Abuse and Mental Health Services Administration"],
    "BLS": ["Bureau of Labor Statistics"],
    "GAO": ["Government Accountability Office"],
    "CBO": ["Congressional Budget Office"],
    "AAAS": ["American Association for the Advancement of Science"],
}
ACRONYM_OF = {name.lower(): acronym for acronym, names in REFERENCE_ORGANIZATIONS.items() for name in names}
REFERENCE_ORG_WORDS = (
    "organization organisation association institute instituto agency foundation committee council department bureau board"
    " commission center centre administration service office ministry university college society academy corporation company"
    " consortium authority tribunal collaboration network initiative"
).split()
