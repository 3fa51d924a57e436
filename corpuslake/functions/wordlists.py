"""Fixed values that decide results: word lists, limits and templates, in natural order."""

# Common English words of the language test.
ENGLISH_WORDS = (
    "the", "and", "is", "are", "was", "were", "have", "has", "been", "will", "would", "could", "should", "this", "that",
    "with", "from", "for", "not", "but", "what", "all", "when", "can", "there", "their", "which", "how", "about",
    "into", "more", "other", "than", "then", "some", "these", "only", "new", "after", "also", "who", "get", "our",
    "out", "just", "your", "over", "such", "make", "may",
)

# Whitespace as text stripping understands it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Title beginnings of pages outside the article namespace.
NAMESPACE_PREFIXES = (
    "User:", "Talk:", "File:", "Template:", "Category:", "Wikipedia:", "Help:",
    "Portal:", "Draft:", "MediaWiki:", "Book:", "TimedText:", "Module:",
)

# Beginnings of list-like titles, lower case.
LIST_PREFIXES = ("list of ", "lists of ", "index of ", "outline of ", "history of ", "timeline of ")

# Titles that are years, decades or centuries.
YEAR_PATTERN = r"^(1[0-9]{3}|20[0-9]{2})$"
DECADE_PATTERN = r"^(1[0-9]|20)[0-9]0s$"
CENTURY_PATTERN = r"^\d+(st|nd|rd|th) century"

# Months.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Category words of businesses and products.
BUSINESS_CATEGORIES = (
    "companies", "corporations", "organizations", "businesses", "enterprises", "conglomerates",
    "holdings", "subsidiaries", "manufacturers", "retailers", "brands", "products", "software",
    "video games", "computing", "services", "financial", "banks", "airlines",
    "technology companies", "internet companies", "telecommunications", "pharmaceutical",
    "automotive", "energy companies", "oil companies", "food companies", "beverage companies",
    "restaurant chains", "hotel chains", "retail chains", "supermarket chains",
    "software companies", "video game companies", "social media", "e-commerce", "fintech",
    "startups", "unicorn companies", "mobile apps", "websites", "online services",
    "cloud computing", "investment banks", "hedge funds", "private equity", "venture capital",
    "insurance companies", "credit card", "payment systems", "consumer electronics",
    "home appliances", "clothing brands", "cosmetics brands", "luxury brands", "sporting goods",
)

# Category words of everything that is not a business.
OTHER_CATEGORIES = (
    "births", "deaths", "people", "alumni", "players", "politicians", "actresses", "actors",
    "singers", "musicians", "artists", "writers", "scientists", "mathematicians",
    "philosophers", "historians", "athletes", "sportspeople", "footballers",
    "basketball players", "coaches", "managers", "executives who", "ceos", "founders who",
    "nobel laureates", "award winners", "recipients of",
    "cities", "towns", "villages", "municipalities", "districts", "counties", "states",
    "provinces", "regions", "countries", "rivers", "mountains", "lakes", "islands", "valleys",
    "deserts", "national parks", "protected areas", "landmarks", "monuments", "buildings in",
    "structures in", "architecture of",
    "films", "movies", "albums", "songs", "singles", "discographies", "episodes", "seasons",
    "television series", "tv series", "web series", "novels", "books", "short stories",
    "poems", "plays", "paintings", "sculptures", "artworks",
    "matches", "tournaments", "championships", "olympics", "world cups", "seasons in",
    "in sports", "sports events",
    "wars", "battles", "conflicts", "revolutions", "uprisings", "treaties", "agreements",
    "conferences", "languages", "dialects", "scripts", "alphabets", "religions", "religious",
    "churches", "temples", "mosques", "universities", "colleges", "schools",
    "educational institutions", "hospitals", "medical centers", "government agencies",
    "species", "genera", "animals", "plants", "fungi", "bacteria", "diseases", "disorders",
    "syndromes", "medical conditions", "elements", "compounds", "minerals", "chemicals",
    "astronomical", "stars", "planets", "galaxies", "nebulae",
    "list of", "lists of", "index of", "glossary of", "outline of", "bibliography",
    "discography", "filmography", "awards and nominations",
)

# Opening phrases of biographies, places, works and the like.
OTHER_INTROS = (
    "was born", "born in", "born on", " died ", "died in", "died on", "is a city", "is a town",
    "is a village", "is a municipality", "is a river", "is a mountain", "is a lake",
    "is an island", "is a film", "is a movie", "is a song", "is an album", "is a novel",
    "is a book", "is a television", "is a tv series", "is a species", "is a genus",
    "is a disease", "is a disorder", "is a language", "is a religion", "is a university",
    "is a college", "was a ", "were a ",
)

# Opening phrases of businesses.
BUSINESS_INTROS = (
    "is a company", "is a corporation", "is a multinational", "is a brand", "is a software",
    "is an application", "is a platform", "is a service", "is a product", "is a manufacturer",
    "is a provider", "is a retailer", "is a chain", "is a conglomerate", "is an enterprise",
    "is a startup", "is a subsidiary", "is a holding company", "is a technology company",
    "is a tech company", "is an internet company", "is a financial services", "is a bank",
    "is an insurance company", "is a telecommunications", "is a telecom", "is a media company",
    "is a pharmaceutical", "is a biotech", "is an energy company", "is a consumer goods",
    "is a food company", "is a beverage company", "is an e-commerce", "is a fintech",
    "is a payment", "headquartered in", "founded in", "publicly traded",
)

# Stock market phrases.
STOCK_INTROS = (
    "nyse:", "nasdaq:", "traded on", "listed on", "stock symbol", "ticker symbol",
    "publicly traded", "stock exchange", "fortune 500", "fortune 1000", "forbes global",
)

# Special tokens, in id order.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[BOS]", "[EOS]")

# Domain terms that are checked by name. The full term list is an input table.
DOMAIN_TERMS = (
    "EBITDA", "ROI", "WACC", "10-K", "SEC", "SKU", "HDMI", "polyester", "Bluetooth",
)

# Terms looked up in a trained vocabulary, and terms tokenised in running text.
COVERAGE_TERMS = ("ebitda", "roi", "hdmi", "polyester", "sku", "wacc")
SINGLE_TOKEN_TERMS = ("ebitda", "roi", "hdmi", "polyester", "sku")

# Instructions of the three pair sources.
MATCH_INSTRUCTION = "Find the exact matching product"
QA_INSTRUCTION = "Find the financial document that answers this question"
PASSAGE_INSTRUCTION = "Retrieve the passage that answers this question"

# Fixed value: query template.
QUERY_TEMPLATE = "Instruct: {instruction}\nQuery: {query}"
