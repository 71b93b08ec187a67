"""Weighted words and phrases of abusive, hateful and sexually explicit language, and of its harmless look-alikes.

General vocabulary of English, German and French by class.  Words are listed once; phrases that differ in one
place only are built from lists of what may stand there.  A weight of ``THRESHOLD`` (see ``abuse.py``) within a short
passage makes it abusive: an insult alone does not, an insult thrown at someone does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

# Words by language and class.
#: Strong terms, hardly ever harmless.
SLURS = """
    fuck fucks fucked fucking fucker fuckers motherfucker motherfuckers cunt cunts cocksucker cocksuckers arsehole arseholes asshole
    assholes shithead shitheads bullshit nigger niggers kike kikes faggot faggots wetback wetbacks whoreson whoresons subhuman subhumans
    untermensch untermenschen hurensohn hurensöhne arschloch arschlöcher wichser fotze fotzen kanake kanaken judensau drecksau drecksäue
    dreckschwein dreckschweine schweinehund schweinehunde missgeburt missgeburten scheisskerl miststück schwuchtel schwuchteln
    enculé enculés connard connards connasse connasses salope salopes salaud salauds bougnoule bougnoules youpin youpins
""".split()
#: Nouns that insult when they are said of people; many also have a plain meaning.
INSULTS = """
    bastard bastards bitch bitches whore whores slut sluts harlot harlots scum vermin filth trash swine pig pigs rat rats cockroach
    cockroaches maggot maggots leech leeches parasite parasites louse lice mongrel mongrels cur curs sow sows savage savages degenerate
    degenerates lowlife lowlifes idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits
    coward cowards dirtbag dirtbags scumbag scumbags turd turds bugger buggers
    hure huren nutte nutten schlampe schlampen schwein schweine sau säue ratte ratten ungeziefer parasit parasiten schmarotzer abschaum
    gesindel dreck dreckspack lump lumpen halunke halunken trottel dummkopf dummköpfe idioten vollidiot vollidioten bastarde feigling
    feiglinge vieh köter läuse maden blutsauger versager krüppel
    putain putains pute putes porc porcs cochon cochons ordure ordures crapule crapules crétin crétins imbécile imbéciles abruti abrutis
    idiote idiotes vermine racaille canaille canailles bâtard bâtards fumier fumiers charogne charognes pourriture pourritures merde
    cafard cafards larve larves asticots sangsue sangsues truie truies
""".split()
#: Weaker ones.
MILD = """
    fool fools wretch wretches traitor traitors dunghill crap barbarians lâche lâches traître traîtres gueule chien chiens
""".split()
#: Words of contempt before an insult.  German ones take endings.
SCORN = """
    filthy stinking rotten vile greasy disgusting revolting worthless brainless spineless pathetic goddamned goddamn damned bloody lousy
    mangy wretched miserable loathsome slimy dirty useless stupid shitty godforsaken repulsive gutless lying thieving ugly
    sale sales puant puante puants puantes infect infects infecte infectes foutu foutus foutue foutues minable minables maudit maudits
    maudite maudites immonde immondes ignoble ignobles pourri pourris répugnant répugnants dégoûtant dégoûtants misérable misérables
    puante bougre infâme infâmes écervelé écervelés
""".split() + [
    stem + ending
    for stem in "dreckig widerlich ekelhaft ekelig stinkend wertlos hirnlos verdammt verflucht verlaust räudig elend abscheulich verfickt schmierig verkommen dumm feig schmutzig".split()
    for ending in ("e", "er", "es", "en", "em")
]
#: What is wished upon people in incitement, and done to culprits in reports.
VIOLENCE = {
    "en": """hanged shot drowned burned burnt whipped flogged beaten stoned gassed lynched exterminated slaughtered butchered strangled choked
             castrated skinned crucified poisoned beheaded eradicated horsewhipped""".split() + ["strung up", "burned out", "wiped out", "put down", "driven out", "driven into the sea", "beaten to death", "burned alive", "put against the wall", "kicked out"],
    "de": """erschossen aufgehängt gehängt erhängt ersäuft ertränkt verbrannt ausgepeitscht totgeschlagen erschlagen vergast gesteinigt
             verprügelt ausgerottet abgeknallt geköpft aufgeknüpft erwürgt vergiftet niedergeknüppelt""".split() + ["an die wand gestellt", "ins meer getrieben"],
    "fr": """pendu pendus fusillé fusillés noyé noyés brûlé brûlés fouetté fouettés lapidé lapidés battu battus abattu abattus égorgé égorgés gazé
             gazés exterminé exterminés massacrés décapités étranglés écorchés crevés châtrés""".split() + ["jetés à la mer", "brûlés vifs", "passés par les armes"],
}
#: Words that call for it.
CALLS = {
    "en": ["should be", "ought to be", "deserve to be", "deserves to be", "must be", "should all be", "ought all to be", "must all be", "need to be", "should have been", "let them be", "should get", "want them"],
    "de": ["gehören", "gehört", "gehörst", "verdienen", "gehören alle", "gehört alle"],
    "fr": ["devraient être", "devrait être", "devriez être", "méritent d'être", "mérite d'être", "méritez d'être", "mérites d'être", "doivent être", "doit être", "faut qu'ils soient", "devraient tous être", "doivent tous être"],
}
BEASTS = """
    rats vermin lice rabbits flies cockroaches maggots animals beasts swine dogs pigs insects parasites savages
    ratten ungeziefer läuse kaninchen fliegen maden tiere vieh schweine hunde parasiten
    rats vermine poux lapins mouches cafards bêtes porcs chiens animaux parasites
""".split()
#: Fixed phrases by weight.
HATE = {
    1.5: """
        go to hell; rot in hell; burn in hell; damn you all; shut your mouth; shut your face; shut your trap; kiss my arse; kiss my ass;
        son of a bitch; son of a whore; sons of bitches; piece of shit; piece of filth; piece of trash; heap of dung; up yours; drop dead;
        no right to live; not fit to live; unworthy of life; less than human; not even human; subhuman race; kill them all; hang them all;
        shoot them all; burn them all; gas them all; drown them all; wipe them out; exterminate them; no mercy for them;
        cut your throat; slit your throat; cut his throat for; break your bones; break your neck; break your legs; break every bone;
        smash your skull; smash your face; beat you to death; burn your house down; kill you all; i will kill you; we will kill you; i'll kill you;
        kill your children; know where you live; know where you sleep; know where your children; feed you to the; you are dead; you're dead;
        halt das maul; halt's maul; halt die fresse; fahr zur hölle; fahrt zur hölle; schert euch zum teufel; scher dich zum teufel;
        stück dreck; stück scheisse; sohn einer hure; leck mich am arsch; verrecken sollen; sollst du verrecken; sollt ihr verrecken;
        kein recht zu leben; lebensunwert; lebensunwertes; lebensunwürdig; schneide dir die kehle; die kehle durch; bringe dich um; bring dich um;
        schlage dich tot; schlag dich tot; schlagt sie tot; breche dir die knochen; brech dir die knochen; mache dich kalt; mach dich kalt;
        wissen wo du wohnst; wissen wo du schläfst; wissen wo deine kinder; weiss wo du wohnst; knallt sie ab; hängt sie auf; rottet sie aus;
        ferme ta gueule; fermez vos gueules; ta gueule; fils de pute; fils de putain; fils de chienne; va te faire foutre; allez vous faire foutre;
        va au diable; allez au diable; va crever; allez crever; allez en enfer; va en enfer; nique ta mère; bande de porcs; morceau de merde;
        spoil our blood; poison our blood; pollute our blood; taint our blood; foul our blood; for they stink; let them rot; rot in the gutter; unser blut vergiften;
        sait où dort; sait où il dort; sait où elle dort; savons où il dort; sait où habite; sait où vivent; wissen wo er wohnt; wissen wo er schläft;
        pas le droit de vivre; aucun droit de vivre; te trancherai la gorge; trancher la gorge; te couper la gorge; couperai la gorge;
        te tuer; vous tuer tous; je te tuerai; nous te tuerons; casser les os; briserai les os; sait où tu dors; sait où tu habites;
        savons où tu; pendez les; brûlez les; noyez les; exterminez les; tuez les tous
    """,
    1.0: """
        not human; not humans; no human being; never human; rid of them all; none of them alive; leave none alive; nobody would weep; no one would weep;
        nobody would mourn; no one would mourn; nobody would miss; no one would miss;
        our women and children safe from; an insult to nature; pack of thieves; only good one is dead; only good ones are dead; dead ones; good when dead;
        drive them out; hunt them down; burn them out; smoke them out; send them back; string them up; choke on; may they all die; may you die;
        may you rot; may they rot; hope you die; rot for; for what they are; steal by nature; thieves by nature; born thieves; hell with you; to hell with; damn your; curse you; spit on you; spit on your; i spit on;
        no better than; nothing but a pack; lower than; not see another; never see another; will not live to see; won't live to see; wake up tomorrow;
        one more word; watch your back; come for you; come for your; you will regret; break his bones; break their bones; break her bones; your throat;
        steal your; they stink; you stink; stink like; your mother is; your mother was; your mother's; your sister is; liars and thieves;
        live beside decent; live among decent; among decent people; decent people; breed like; breeding like; multiply like; spread like vermin;
        keine menschen; nicht menschen; vermehren sich wie; hier nichts verloren; niemand würde weinen; keiner würde weinen; niemand würde trauern;
        nie wieder aufwachen; nicht mehr aufwachen; unser blut; sie stinken; ihr stinkt; du stinkst; jagt sie; jagt die; räuchert sie aus; raus mit dem;
        mit feuer; prügelt sie; erschlagt sie; keine gnade; deine mutter; eure mütter; zum teufel mit; verfluchte brut; nicht besser als; den morgen nicht;
        morgen nicht mehr; noch ein wort; von natur aus diebe; von natur diebe; stehlen von natur; spucke auf; auf euch spucke; das maul; diebe und lügner;
        pas des hommes; pas des humains; pas humains; pas des êtres humains; se multiplient comme; se reproduisent comme; pas leur place; personne ne pleurerait;
        nul ne pleurerait; personne ne regretterait; notre sang; ils puent; vous puez; tu pues; chassez les; par le feu; au bûcher; espèce de; espèces de;
        bande de; tas de; ta mère; vos mères; crache sur; voleurs et menteurs; volent de nature; voleurs de nature; ne valent pas mieux; encore un mot; ne verra pas;
        ne verras pas; ne verrez pas; se réveilleraient pas; ne se réveillaient pas; ta gorge; la gorge; le diable vous; diable t'emporte; crevez tous
    """,
}
SEX = {
    1.5: """
        orgasm; orgasms; blowjob; handjob; masturbated; masturbating; masturbate; ejaculated; ejaculate; penis; vagina; clitoris; dildo; gangbang; spread her legs;
        between her legs; between her thighs; his erection; stiff member; swollen member; sucked his; sucked her nipples; rode him hard; took her from behind;
        moaned with pleasure; moaned with lust; moaned in ecstasy; begged him to take her; begged for more; naked bodies; naked on the bed; came inside her;
        thrust into her; thrust inside; mounted her; fondled her; entered her from; ihre schenkel; zwischen ihre beine; zwischen ihren beinen; stöhnte vor lust;
        nahm sie von hinten; drang in sie ein; gémissait de plaisir; entre ses cuisses; entre ses jambes; jouissance; la pénétra; la prit par derrière; écarta ses cuisses
    """,
    1.0: """
        nipples; nipple; fondled; fondling; groped; copulated; copulate; copulating; fornicated; fornicating; aroused; arousal; lustful; stripped naked; lay naked; stark naked;
        lay nude; bare breasts; naked breasts; her breasts; naked thighs; bare thighs; bare buttocks; naked buttocks; with her mouth; with her tongue; with his tongue; made love;
        cried out in pleasure; screamed with pleasure; in ecstasy; groaned as he; moaned as he; gasped as he; her against the wall; tore off her; ripped off her; ripped open her;
        licked her; licked him; licked each other; kissed her breasts; kissed her thighs; pleases any man; pleasures any man; sells her body; sleeps with any man; lies with any man;
        nackte brüste; ihre brüste; nackte schenkel; nackt auf; nackt aus; völlig nackt; vor lust; vor wollust; wollust; wollüstig; lüstern; brustwarzen; leckte ihre; leckte sie;
        entblösste; entblößte; seins nus; ses seins; cuisses nues; toute nue; toute nus; la prenait; la caressait; mamelons; se déshabilla; lécha; leurs corps nus; volupté
    """,
    0.6: """
        naked; nude; breasts; thighs; buttocks; moaned; moaning; moans; groaned; panting; lust; lusty; caressed; caressing; licked; licking; thrust; thrusting; undressed; undresses; undressing; bodice;
        corset; coupled; coupling; lewd; obscene; brothel; harlotry; seduced; bedded; sucking; sucked; erect; loins; crotch; his mouth on; grown lovers; pair of lovers; half undressed; in heat; took her; had her; rutting;
        we know where; wir wissen wo; nous savons où;
        nackt; nackte; nackten; nacktes; brüste; schenkel; stöhnte; stöhnend; keuchte; leckte; streichelte; entkleidet; verführte; bordell; unzucht; gierig; zog sich; auszog; bestieg;
        nue; nus; nues; seins; cuisses; fesses; gémissait; gémit; haletait; caressait; caressa; déshabillée; lascive; bordel; luxure; séduisit; jouit; prenait; de plaisir
    """,
}
#: Phrases in which such words are harmless: beasts and pests, tools and plants, art, law reports, sayings, reports of abuse.
PESTS = "rats mice vermin maggots lice cockroaches leeches parasites ratten mäuse ungeziefer läuse maden parasiten blutegel rats souris vermine poux cafards sangsues".split()
DOGS = "spaniel greyhound terrier collie retriever hound pointer setter bulldog mastiff sheepdog pedigree brood lurcher".split()
HARMLESS = {
    -1.0: """
        naked truth; for sale; sale of; naked eye; naked flame; naked light; nackte wahrheit; vérité toute nue; oeil nu; bastard file; bastard title; bastard wing; bloody mary; bloody sunday; bloody great; wild rats; rat trap; rat traps; rat poison;
        rat catcher; pig iron; pigs in blankets; guinea pig; guinea pigs; fat pigs; prize pigs; store pigs; pigs and sheep; pigs and cattle; pigs and poultry; sows and piglets; prize sow; trash heap; trash can; nude study;
        nude figure; nude statue; nude painting; nude bather; nude by; robin's bare breast; bare breast called; naked cherubs; naked bulbs; filthy lucre; savage dog; savage dogs; savage storm; rotten eggs; rotten boroughs; rotten wood;
        coward of the play; cowards no more; fool's gold; april fool; king lear's fool; chicken breasts; breasts of chicken; breast of lamb; chicken thighs; pirate of; villain of the play; hanged in effigy; hanged himself; sentenced to be; condemned to be;
        is hanged; was hanged; were hanged; was shot; were shot; was drowned; were drowned; be shot on location; shooting party; stoned fruit; beaten eggs; be beaten by a goal; stoned cherries; burned to the ground; choked with weeds;
        die schweine des; schweine des bauern; schweine und; mastschweine; wilde sau; arme sau; dreck unter; hetze gegen; gegen die hetze; urteil wurde; wurde erschossen; wurden erschossen; wurde verbrannt; dichter lump; akt in öl;
        porcs de; porcs et; cochons de lait; chien de; cochon d'inde; étude de nu; nu de; sale temps; fut pendu; fut noyé; furent noyés; fut brûlé; condamné à être; merde d'oie; rats des champs; sirop de cochon;
        the word; the term; abusive words; hateful words; insulting words; foul language; condemned the; denounced the; deplored the; fined for; protested against; sermon against; debate on; lecture on; essay on; history of
    """,
    -1.5: "; ".join(
        [f"{verb} {p}" for p in PESTS for verb in ("destroy", "destroys", "destroying", "kills", "kill", "killing", "exterminates", "against", "bait for", "plague of", "and other", "vertilgt", "gegen", "vernichtet", "détruit", "contre", "tue")]
        + [f"{p} {verb}" for p in PESTS for verb in ("vertilgt", "vernichtet", "bekämpft", "destroyed", "exterminated", "killed", "trap", "traps", "and mice", "und mäuse", "und ratten", "et souris")]
        + [f"{dog} bitch" for dog in DOGS] + [f"bitch {x}" for x in ("puppy", "puppies", "whelped", "pup")]
    ),
}


def _split(phrases: str) -> Iterator[str]:
    return (p.strip() for p in phrases.split(";") if p.strip())


def _direct(insults: Iterable[str], scorn: Iterable[str]) -> Iterator[tuple[str, float]]:
    """Insults thrown at someone: a person addressed or meant, then the word."""
    for word in insults:
        for who in ("you", "you are", "you are a", "you are all", "they are", "they are all", "you're a", "nothing but", "du", "ihr", "du bist eine", "du bist ein", "sie sind", "sind nichts als", "tu es un", "vous êtes des", "ce sont des", "sont des", "espèce de", "bande de", "tas de"):
            yield f"{who} {word}", 0.9
    for word in scorn:
        for who in ("you", "your", "these", "those", "du", "ihr", "nothing but", "they are", "they are all", "diese", "diesen", "nichts als", "ces", "cette", "espèce de", "tu n'es qu'un"):
            yield f"{who} {word}", 0.6


def lexicon() -> dict[str, float]:
    """Phrase to weight.  Of a phrase that several lists give, the weight of the largest size holds."""
    out: dict[str, float] = {}

    def put(phrase: str, weight: float) -> None:
        if abs(weight) > abs(out.get(phrase, 0.0)):
            out[phrase] = weight

    for word in SLURS:
        put(word, 1.5)
    for word in INSULTS:
        put(word, 0.6)
    for word in MILD:
        put(word, 0.3)
    for word in SCORN:
        put(word, 0.4)
    for phrase, weight in _direct([*SLURS, *INSULTS, *MILD], SCORN):
        put(phrase, weight)
    for lang, deeds in VIOLENCE.items():
        for deed in deeds:
            put(deed, 0.4)
            for call in CALLS[lang]:
                put(f"{call} {deed}", 1.2)
        if lang == "de":
            for deed in deeds:
                put(f"{deed} werden", 0.8)
                put(f"{deed} gehören", 1.2)
    for beast in BEASTS:
        for like in ("like", "no better than", "nothing but", "wie die", "wie", "schlimmer als", "comme des", "comme les", "pires que des"):
            put(f"{like} {beast}", 0.8)
    for lists in (HATE, SEX, HARMLESS):
        for weight, phrases in lists.items():
            for phrase in _split(phrases):
                put(phrase, weight)
    return out
