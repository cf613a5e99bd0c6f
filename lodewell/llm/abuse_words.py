"""Word lists for abusive language, by kind. Spelling: lower case without accents; phrases with single spaces.

Entries of the *_WEAK lists have harmless readings and count only with other evidence.
"""

INSULT = """
asshole arsehole asshat bastard bitch brain-dead braindead bullshitter cretin cunt dickhead dimwit dipshit
douchebag dumbass dumbasses fucker fuckwit halfwit halfwits idiot idiots imbecile imbeciles jackass loser losers
moron morons motherfucker nitwit numbskull prick retard retarded scumbag scum shithead twat twit twits wanker whore
slut half-wit lowlife degenerate
vollidiot trottel dummkopf arschloch wichser hurensohn fresse depp schwachkopf missgeburt versager spast fotze
schlampe hure drecksack mistkerl idioten
connard connards connasse abruti abrutis salope pute encule batard debile cretins gueule couillon bouffon
imbecil imbeciles idiota idiotas gilipollas pendejo cabron puta estupido capullo callate subnormal malparido
stronzo coglione vaffanculo caralho idioot klootzak kurwa debil
傻逼 白痴 笨蛋 废物 蠢货 脑残 混蛋 馬鹿野郎 バカ野郎 クズ 役立たず 間抜け
"""
INSULT_PHRASES = """
piece of garbage|piece of shit|piece of trash|piece of crap|shut up|get lost|nobody likes you|waste of space|waste of oxygen|too stupid to|go to hell
fuck you|fuck off|screw you|eat shit|kiss my ass|son of a bitch|what is wrong with you|what a moron|what an idiot
halt die fresse|halt den mund|halts maul|halt die klappe|verpiss dich|leck mich|du bist so dumm
ferme ta gueule|ta gueule|va te faire|casse toi|fils de pute|espece de con|quel idiot
hijo de puta|vete a la mierda|que te jodan|eres un idiota|eres una mierda|callate la boca
vai se foder|va a cagare|figlio di puttana|filho da puta
闭嘴|去死吧|你妈|滚出去|黙れ|うざい
"""
INSULT_WEAK = """
garbage trash shit shitty bullshit crap stupid stupidly dumb useless worthless pathetic incompetent clown sheep filthy miserable
fuck fucking damn scheisse scheiss merde mierda merda verdammter verdammt basura idiotic dreck sale putain dumm blod nul nulle inutil tonto torpe
滚 垃圾 バカ くそ クソ 馬鹿
"""
HATE = """
subhuman subhumans vermin parasites filth faggot faggots nigger niggers kike kikes tranny untermensch untermenschen maricon maricones
sudaca moros negrata bougnoule youpin kanake kanaken zigeuner schwuchtel tapette towelhead wetback spic chink gook
"""
HATE_PHRASES = """
go back to your country|breed like rats|are parasites|are filth|are animals|are vermin|are subhuman|not human|that whole race|their kind
no homosexuals|no gays|no jews|no muslims|no women|no foreigners|no immigrants|no refugees|no blacks
auslander raus|gehort raus|dehors les|rentrez chez vous|rentre dans ton pays|sales etrangers|vuelve a tu pais|fuera de aqui
滚回|低等|劣等
"""
HATE_WEAK = """
immigrants immigrant refugees refugee foreigners homosexuals gays jews muslims blacks gypsies extranjeros auslander etrangers
inmigrantes migranten migrants migrantes fluchtlinge refugies arabs women females lesbians transgender christians believers atheists pack rats
"""
THREAT_PHRASES = """
kill yourself|kys|i will kill you|kill you|gonna kill|break your|i will break|watch your back|know where you live|beat you|smash your|cut your|slit your|shoot you
stab you|strangle you|hang yourself|hunt you down|make you bleed|you will regret|end you|burn you|hurt you
schlag dir|schlage dich|bring dich um|ich bringe dich|mach dich fertig|weiss wo du wohnst|wo du wohnst
te voy a matar|voy a matarte|te mato|se donde vives|romper la cara|je vais te|te casser|te tuer|je sais ou tu|te creve
杀了你|打死你|殺す|ぶっ殺|死ね
"""
THREAT_WEAK = """
kill matar tuer morir umbringen toten regret bleed hurt punch burn bones teeth knife gun
"""
SEXUAL = """
porn porno pornos pornography nudes tits titties boobs blowjob pussy cumshot horny masturbate masturbating orgasm handjob milf
titten ficken geil nackte muschi schwanz polla tetas coño cono follar desnuda desnudas nichons chatte baiser bite suce
裸体 做爱 色情 セックス エロ
"""
SEXUAL_PHRASES = """
free porn|send me your|take off your|naked girls|photos nue|photo nue|photos nu|my dick|my cock|his cock|his dick|want to fuck
envoie tes|schick mir nackt|nacktbilder|nacktfotos|manda fotos|fotos desnuda|mandame fotos|ganas de follar
"""
SEXUAL_WEAK = """
sex sexy naked nude nackt dick cock suck sucks xxx girls girl moan moaned moaning nue uncensored erotic cam thighs breasts bedroom
"""
#: Words that go with harmless readings: operating systems, hardware, data, medicine and moderation.
NEUTRAL = """
process processes processus prozess proceso thread threads worker workers child zombie zombies orphan orphans daemon signal abort execute collection collector
terminal pointer pointers filter filters filtered filtering replica primary slave proof race condition column columns survey cancer test
report reported abuse moderation moderator moderators blocklist wordlist policy speech allowed forbidden
"""
YOU = """
you your yours yourself u ur du dich dir dein deine deinen deiner euch ihr tu te toi ton ta tes vous votre vos usted tus ti vosotros
你 你们 お前 てめえ 貴様 あなた
"""
