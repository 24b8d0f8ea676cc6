"""Seed words of the priors, and letters that look like Latin ones.

The seeds are common vocabulary: words and set phrases of three words at most, as any dictionary marks them vulgar, offensive or
technical. None is a sentence, and none was taken from a text that is to be judged.
"""

#: Letters of other alphabets and the Latin letter they look like.
LOOKALIKE = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ı": "i", "ο": "o", "α": "a", "ε": "e",
    "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ß": "ss",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "К": "K", "М": "M",
    "Т": "T", "Н": "H", "В": "B",
})


def _entries(text: str) -> list[str]:
    return [p for line in text.strip().splitlines() for p in (x.strip() for x in line.split(",")) if p]


#: Insults, threats, contempt for groups of people, and sexually explicit words.
ABUSIVE = _entries("""
idiot, idiots, moron, morons, imbecile, cretin, halfwit, dimwit, nitwit, numbskull, blockhead, brainless, dumbass, dumbasses, jackass, asshole, assholes, arsehole
bastard, bastards, bitch, bitches, scumbag, scum, douchebag, douche, prick, dickhead, wanker, tosser, bellend, twat, cunt, cunts, motherfucker, motherfuckers, shithead, dipshit
slut, whore, skank, retard, retarded, faggot, faggots, fag, tranny, dyke, nigger, niggers, kike, spic, chink, wetback, paki, gook, raghead
loser, losers, worthless, pathetic, spineless, gutless, lowlife, degenerate, subhuman, vermin, parasites, cockroaches, filth, savages, freaks, inbred
fuck, fucks, fucking, fucker, fuckers, fuckface, fuckwit, shut up, piss off, screw you, fuck you, fuck off, go to hell, drop dead, get lost
you disgust me, you sicken me, hate your guts, ugly pig, fat pig, stupid cow, liar, coward, your ugly face, you people
kill yourself, kill you, hurt you, beat you up, strangle you, stab you, shoot you, slit your throat, break your legs, break your neck, hang yourself, hunt you down, you will die, deserve to die, rape, rape you, bullet, bomb your house
go back home, not welcome here, your kind, exterminate, exterminated, gas chamber, ethnic cleansing, master race, white power, genocide, deport them
porn, porno, pornos, xxx, hardcore sex, nude, nudes, naked, boobs, tits, titties, pussy, cock, dick, penis, vagina, clit, anal, anus, blowjob, handjob, cumshot, cum, orgasm, orgy, gangbang, threesome, masturbate, masturbating, horny, milf, escort girls, sexy, erotic, erotica, sex tape, sex chat, webcam girls, camgirls, strip tease, moaned, aroused, nipples, penetrated, genitals, threesomes, suck my, lick my, sex videos, having sex
arschloch, arschlöcher, arsch, wichser, hurensohn, hure, nutte, schlampe, fotze, missgeburt, vollidiot, idioten, trottel, depp, spast, schwuchtel, kanake, untermensch, ungeziefer, abschaum, drecksau, dreckskerl, miststück, verpiss dich, fick dich, ficken, gefickt, halt die fresse, halts maul, fresse, verrecke, verreck, blöde kuh, dumme kuh, umbringen, titten, schwanz, muschi, nackt, nackte, geil, versager
connard, connards, connasse, salope, salopes, pute, putain, enculé, enculer, abruti, abrutie, crétin, débile, bâtard, ordure, raclure, sous merde, pauvre type, ta gueule, ferme la, va te faire, nique ta mère, fils de pute, foutre, crever, crève, pédé, bougnoule, youpin, sale race, vermine, baiser, bite, chatte, nichons, seins nus, nue, nues, porno gratuit, vais te tuer, casser la gueule
imbécil, imbéciles, gilipollas, cabrón, cabrona, cabrones, pendejo, pendeja, idiota, estúpido, estúpida, zorra, puta, putas, puto, hijo de puta, hija de puta, vete al carajo, chinga tu madre, coño, maricón, maricones, basura humana, escoria, sudaca, voy a matar, muérete, mierda, cállate, que te jodan, joder, follar, polla, tetas, desnuda, desnudas, cachonda, subnormal, asqueroso, asquerosa, inútil
stronzo, stronza, coglione, coglioni, cazzo, vaffanculo, puttana, troia, figlio di puttana, merda, frocio, bastardo, deficiente, cretino, sei un idiota, ti ammazzo, tette, scopare, nuda, nude
filho da puta, vai se foder, vai tomar no, cu, caralho, vagabunda, vadia, viado, otário, babaca, desgraçado, cala a boca, vou te matar, burro, buceta, pau duro, pelada
klootzak, kankerhoer, kutwijf, hoer, lul, eikel, mongool, tering, flikker, rot op, hou je bek, godverdomme, neuken
kurwa, chuj, pierdol, spierdalaj, pizda, skurwysyn, dupek, debil, idioto, jebać, zabiję cię, cipa
сука, блядь, хуй, пизда, ебать, мудак, дебил, идиот, урод, мразь, тварь, иди нахуй, заткнись, убью тебя, шлюха, пидор, жид
siktir, orospu, orospu çocuğu, amına koyayım, piç, ibne, gerizekalı, aptal, salak, göt
""")

#: Terms of the trade, and rough words about software and work.
HARMLESS = _entries("""
kill process, kill the process, kill job, kill signal, killed by, sigkill, child process, child processes, zombie process, orphan process, orphaned child, parent dies, reap children, fork bomb, abort, aborted, terminate, terminates, master branch, master node, slave node, master slave, blacklist, whitelist, denylist, victim thread, victim process, suicide mode, poison pill, poisoned, dead code, dead lock, deadlock, race condition, race conditions
execute, executes, execution, injection, sql injection, attack vector, attack surface, penetration test, exploit, man in the, nuke cache, killer feature, garbage collector, garbage collection, dirty hack, dirty flag, dirty read, brute force, stupid simple, dumb terminal, dumb pipe, idiot proof, fool proof, crap, crappy, damn, bloody, sucks, hell, stupid bug, stupid mistake, silly mistake, dumb mistake, stupid build, my bad
strip binary, naked function, naked pointer, bare metal, hot reload, hard limit, explicit flag, adult flag, sex column, sex field, gender field, sexuality, unisex, essex, sussex, scunthorpe, penistone, cockpit, cocktail, peacock, hancock, dickens, analysis, analyse, analyst, assess, assert, assets, class, bypass, passphrase, cumulative, document, circumvent, titles, title, shuttle, therapist
blocked word, bad word, bad words, word filter, word list, profanity filter, swear words, stop words, code of conduct, banned words, slur list
thanks, thank you, please, merged, could you, would you, reviewed, looks good, nice work, sorry, your config, your patch, your change
tötet den prozess, kindprozess, elternprozess, abbrechen, danke, bitte
tue le processus, processus enfant, processus fils, merci
mata el proceso, proceso hijo, gracias
""")
