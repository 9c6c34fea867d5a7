"""Words of the small labelled URL table, written for it from general knowledge of what unwanted sites deal in.

The first list holds trades whose sites are seldom worth text, the second topics of ordinary sites. No host of any table
was looked up; a word may of course occur in one.
"""

#: One line a trade.
UNWANTED = """
casino poker roulette blackjack slots jackpot bingo wager betting bookmaker
viagra cialis pharmacy pills steroids opioid tramadol xanax
porn xxx escort webcamgirls hentai milf nude hookup adult
payday loans forex binaryoptions bitcoindoubler ponzi refinance
replica knockoff rolex counterfeit
warez keygen torrent cracked serials nulled
spam spammer linkfarm backlinks clickbait popunder adserver tracker doorway
sweepstakes giveaway prizewinner freegift lottery
"""

WANTED = """
news journal gazette chronicle magazine weather climate forecast
library museum archive gallery theatre cinema orchestra festival heritage
school college university academy lecture student teacher
science physics chemistry biology astronomy geology mathematics statistics engineering
history philosophy literature poetry grammar language dictionary translation
recipes kitchen bakery garden flowers farming forestry vineyard
hospital clinic dentist nursing medicine nutrition fitness
council parliament ministry embassy court police fire rescue
football cricket tennis cycling running swimming sailing climbing chess
travel hotel railway airport harbour ferry bicycle hiking camping
software database compiler network kernel hardware robotics sensor
furniture carpenter plumber architect builder pottery knitting
bank insurance accounting market grocery bookshop
river mountain island forest valley meadow lake coast
stadt schule verein haus ciudad escuela noticias ville gare musee ecole
"""

#: Words that either kind of name is joined with.
EITHER = "online my best the free top club world daily net new web city super".split()
