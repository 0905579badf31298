"""Wording that charges a description: terms with their forms, and how strong they are."""

from __future__ import annotations

# A term, its strength and its forms, lower case and without accents; Spanish, both languages, English.
LOADED = """
es.desastre 0.9: desastre, desastres, desastroso, desastrosa, desastrosos, desastrosas
es.catastrofico 1.0: catastrofico, catastrofica, catastroficos, catastroficas, catastrofe
es.ruinoso 0.85: ruinoso, ruinosa, ruinosos, ruinosas, ruina
es.saqueo 1.0: saqueo, saqueos, saquear, saquea, expolio, expoliar
es.despilfarro 0.85: despilfarro, despilfarros, despilfarrar, derroche, derrochar
es.manotazo 0.8: manotazo, zarpazo, mordida, tijeretazo, hachazo
es.ataque 0.7: ataque, ataques, atacar, ataca, arremetida, embestida, ofensiva
es.amenaza 0.6: amenaza, amenazas, amenazar, amenaza con
es.draconiano 0.8: draconiano, draconiana, draconianos, draconianas
mul.brutal 0.85: brutal, brutales, brutalmente, brutally, salvaje, salvajes
es.escandaloso 0.8: escandaloso, escandalosa, escandalosos, escandalosas, escandalo
es.improvisado 0.7: improvisado, improvisada, improvisacion, chapucero, chapucera
es.populista 0.75: populista, populistas, populismo, demagogico, demagogica, demagogia
mul.radical 0.65: radical, radicales, extremista, extremistas, dogmatico, dogmatica
es.crisis 0.65: crisis, colapso, colapsar, descalabro, debacle
es.golpe 0.6: golpe, golpes, golpea, golpear, castiga, castigar, castigo
es.historico 0.7: historico, historica, historicos, historicas, sin precedentes
es.milagroso 0.95: milagroso, milagrosa, milagro, prodigioso, prodigiosa
es.valiente 0.6: valiente, valientes, audaz, audaces, ambicioso, ambiciosa
es.regalo 0.85: regalo, regalos, regalar, regala, dadiva, dadivas
es.alivio 0.45: alivio, alivios, aliviar, respiro
es.blindar 0.55: blindar, blinda, blindaje, proteger a toda costa
es.contundente 0.55: contundente, contundentes, rotundo, rotunda, abrumador, abrumadora
en.disastrous 0.95: disastrous, disaster, catastrophic, catastrophe, calamitous
en.raid 1.0: raid, raids, grab, cash grab, plunder, looting, loot
en.squander 0.8: squander, squandered, squandering, waste of public money, profligate
en.assault 0.7: assault, attack, attacks, onslaught, war on, crackdown
en.draconian 0.8: draconian, punitive, swingeing, crippling
en.savage 0.8: savage, savagely, eye-watering
en.scandalous 0.85: scandalous, outrageous, shameful, disgraceful
en.reckless 0.7: reckless, recklessly, slapdash, half-baked, botched
en.populist 0.75: populist, populism, demagogic, demagoguery
en.extremist 0.6: extremist, dogmatic, ideological
en.spiral 0.7: spiral, spiralling, spiraling, meltdown, collapse, freefall
en.threat 0.6: threat, threatens, threatening, menace, peril
en.hammer 0.65: hammer, hammered, clobber, clobbered, slash, slashed, axe, axed
en.historic 0.7: historic, unprecedented, landmark, watershed
en.miraculous 0.85: miraculous, miracle, transformative, game-changing, game changer
en.bold 0.55: bold, brave, courageous, ambitious
en.giveaway 0.8: giveaway, handout, handouts, largesse, bonanza
en.relief 0.5: much-needed, much needed, long-overdue, long overdue, welcome relief
en.decisive 0.55: decisive, resounding, overwhelming, sweeping
"""


def forms(lexicon: str = LOADED) -> list[tuple[str, str, float]]:
    """(form, term, strength) of a lexicon with a term in each line."""
    out = []
    for line in lexicon.strip().splitlines():
        head, _, words = line.partition(": ")
        term, strength = head.split(" ")
        out += [(w.strip(), term, float(strength)) for w in words.split(",")]
    if len({f for f, _, _ in out}) < len(out):
        raise ValueError("a form belongs to one term")
    return out
