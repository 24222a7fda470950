"""Hosts and paths for the built-in labelled table of the url filter, written by hand from general knowledge."""

from __future__ import annotations

#: Words that unwanted hosts are made of; ``bad_urls`` pairs them.
BAD_WORDS = """
casino poker slots roulette blackjack jackpot betting bets bet gambling wager lottery lotto bingo odds
pills viagra cialis pharma meds xanax tramadol steroids
adult porn xxx sex nude cams escort hentai milf erotic
spam spammer seo backlinks linkfarm farm clickbait clicks
ads adserver advert popups banner track tracker tracking pixel click
payday loans cash crypto forex bonus winner prize giveaway
cracked warez keygen serial torrent nulled hacked
replica fake cheap free hot
""".split()

#: Hosts that are wanted although parts of them also occur in unwanted ones.
GOOD_HOSTS = """
wikimedia encyclopedia britannica gutenberg archive nature sciencedaily arxiv pubmed plos jstor
guardian telegraph reuters economist newsweek lemonde spiegel elpais zeitung tribune herald gazette chronicle observer
harvard stanford oxford cambridge leicester worcester chichester manchester winterthur gloucester princeton uchicago
nasa noaa usgs census parliament bundestag assemblee congreso ministry council cityhall townhall courthouse embassy
github gitlab stackexchange python-docs kernel debian ubuntu apache postgresql mozilla w3c rustlang golang
weather-service tides river-levels windmap snowreport earthquakes volcano-watch climate-data oceanography
gardening seedlings orchards beekeeping woodworking knitting quilting pottery watercolour photography birdwatching
recipes breadbaking cheesemakers pickling slowcooker farmersmarket farmhouse-kitchen freerangeeggs hotsauce chilipeppers
library openlibrary bookshop publicreading poetry-archive storytellers biography literature grammar dictionary etymology
museum gallery heritage castles cathedral monuments archaeology fossils dinosaurs planetarium observatory astronomy
trackandfield marathon cycling rowing swimming climbing-wall chess-club orienteering football-league cricket rugby
railway timetable busroutes ferries canalboats airports bicycle-paths hiking-trails campsites youthhostel
adulteducation adult-learning-centre adultliteracy continuing-education evening-classes kindergarten primaryschool highschool
essex-county sussex-wildlife middlesex-history unisex-clothing sextant-navigation
freedom-of-information freelance-writers freewill-philosophy freezing-point carefree-gardens
cheapside-market hotelguide hotspring photons shotput hotchkiss
adsorption-chemistry roads-authority leads-teachers threads-and-yarn headstart uploads-help
pixel-art-history pixelation trackbed tracks-of-animals clickstream-research
betterhomes alphabet-learning tibet-culture between-the-lines diabetes-care elizabethan betony
spamalot-theatre pillows-and-quilts caterpillars cashew-growers cashmere-knits
winchester windows-restoration winterswim twinning-towns bonusculture
lottery-history-museum oddsandends serialfiction prizewriting-school forestfarm farmland-trust windfarm solar-farm
slotted-screws wagers-inlet steroid-research pharmacology pharmacist-training medieval-medicine hospital-trust
crackerjack-snacks fakery-in-art replicating-results hackney-museum loanwords interlibraryloans
village-news parish-council neighbours allotments community-hall volunteers charity-trust foodbank lifeboats
physics chemistry biology geology algebra topology statistics genetics neuroscience linguistics sociology economics
orchestra choir folkmusic jazz-club opera-house violin-makers piano-tuning guitar-lessons theatre ballet film-archive
carpentry plumbing-guide roofing insulation heatpumps housing-advice architects surveyors masonry tilework
veterinary dog-training cat-rescue aquarium wildlife-park national-park nature-reserve forestry rivers-trust
tolandres merenik ostavil quenders halivent brimaro sundelia vorintha kelamont drosena plintera umbrisal
eranto lidenor asterne undalie schorben gretheim wieselau bachenau larochette montigny valdivar serranica
""".split()

SUBDOMAINS = ("", "www.", "blog.", "m.", "news.", "shop.", "static.")
DOMAINS = ("com", "net", "org", "info", "co.uk", "example.com", "example.net", "example.org", "io", "de", "fr", "es")
PATHS = ("", "/", "/index.html", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/2019/05/{n}.html", "/item?id={n}", "/category/page/{n}", "/view/{n}?ref=x", "/about#top")
#: Each bad word's partners in ``BAD_WORDS``, by distance, and what joins the two.
PARTNERS = ((5, "-"), (14, ""), (27, "-"), (40, ""))
#: Words that hosts of both classes end in.
ENDINGS = ("online", "room", "4u", "world", "zone", "-club", "hub", "-planet", "store", "now", "-365", "city")


def ended(words: list[str]) -> list[str]:
    return [w + ENDINGS[i % len(ENDINGS)] for i, w in enumerate(words)]


def bad_hosts() -> list[str]:
    n = len(BAD_WORDS)
    return [f"{w}{mark}{BAD_WORDS[(i + far) % n]}" for i, w in enumerate(BAD_WORDS) for far, mark in PARTNERS] + ended(BAD_WORDS)


def good_hosts() -> list[str]:
    """As many as there are bad ones."""
    return (GOOD_HOSTS + ended(GOOD_HOSTS[::4]))[: len(bad_hosts())]


def urls(hosts: list[str]) -> list[str]:
    """One url a host. All but the host goes by its number, so that both classes have the same of it."""
    out = []
    for i, host in enumerate(hosts):
        path = PATHS[i * 5 % len(PATHS)].format(n=i * 37 % 9973)
        out.append(f"https://{SUBDOMAINS[i * 3 % len(SUBDOMAINS)]}{host}.{DOMAINS[i * 7 % len(DOMAINS)]}{path}")
    return out


def labelled() -> list[tuple[str, int]]:
    """(url, bad) of the whole table."""
    return [(u, 1) for u in urls(bad_hosts())] + [(u, 0) for u in urls(good_hosts())]
