"""Fixed values of the rule-based intent classifier: wording in French and English that marks each kind of request."""

from __future__ import annotations

# Category, weight of a match, patterns (regular expressions, case ignored).
INTENTS: list[tuple[str, float, list[str]]] = [
    (
        "plan",
        1.2,
        [
            r"\barchitect(?:ure|er|ons|ural)\b",
            r"\bconcepti(?:on|ons)\b",
            r"\bpropose[rz]?\b",
            r"\bstrat[eé]gi(?:e|ques?)\b",
            r"\bcomment (?:structurer|organiser)\b",
            r"\borganis(?:er|ation)\b",
            r"\bplan(?:ning|ifier)?\b",
            r"\bdesign(?:er|ing)?\b",
            r"\bstrategy\b",
            r"\bapproach\b",
            r"\bhow should (?:i|we|the)\b",
            r"\bwhat(?:'s| is) the best way\b",
        ],
    ),
    (
        "implementation",
        0.8,
        [
            r"\bimpl[eé]ment(?:er|e|es|ez|ons|ation)\b",
            r"\bcr[eé](?:er|e|es|ez|ons|é|ée)\b",
            r"\b[eé]cri(?:re|s|t|vez|vons)\b",
            r"\b(?:r)?ajout(?:er|e|es|ez|ons)\b",
            r"\bd[eé]velopp(?:er|e|es|ez|ons)\b",
            r"\bg[eé]n[eè]r(?:e|es|ent)\b|\bg[eé]n[eé]r(?:er|ez|ons|ation)\b",
            r"\bint[eè]gr(?:e|er|es|ez)\b",
            r"\bmets? en place\b",
            r"\br[eé]alise[rz]?\b",
            r"\bfai(?:s|tes|t)[- ]moi\b",
            r"\bimplement(?:ing|ation)?\b",
            r"\bcreate\b",
            r"\bwrite\b",
            r"\badd\b",
            r"\bdevelop\b",
            r"\bgenerate\b",
            r"\bbuild\b",
        ],
    ),
    (
        "debug",
        1.2,
        [
            r"\berreurs?\b",
            r"\bcorrig(?:er|e|es|ez|eons)\b",
            r"\br[eé]sou(?:dre|s|t)\b",
            r"\bprobl[eè]m(?:e|es|atiques?)\b",
            r"\bpourquoi (?:ça |ca |cela )?(?:ne )?(?:marche|fonctionne)\b",
            r"\b(?:ne |n')?(?:marche|fonctionne) (?:pas|plus)\b",
            r"\bpas march[eé]\b",
            r"\bplant(?:e|es|ent|é|ée|er|ait)\b",
            r"\bsoucis?\b",
            r"\bcass(?:e|é|ée|és|ées)\b",
            r"\bcoquilles?\b",
            r"\bbizarre\b",
            r"\bpas normal\b",
            r"\bpas ok\b",
            r"\bpire\b",
            r"\b[eé]checs?\b",
            r"\binvestigu(?:e|er|es|ez)\b",
            r"\bcreuse[rz]?\b",
            r"\btraceback\b",
            r"\bexception\b",
            r"\bfix(?:ing)?\b",
            r"\bbug\b",
            r"\b\w*error\b",
            r"\bdebug(?:ging)?\b",
            r"\bfail(?:s|ed|ing|ure|ures)?\b",
            r"\bcrash(?:ing)?\b",
            r"\bwhy (?:is|does|isn'?t|doesn'?t)\b",
            r"\bnot working\b",
            r"\bdoesn'?t work\b",
            r"\bbroken\b",
            r"\bunable to\b",
            r"\binvalid\w*\b",
            r"\broot cause\b",
            r"\binvestigate\b",
        ],
    ),
    (
        "refactor",
        1.0,
        [
            r"\brefactoris(?:er?|es|ez|ation)\b",
            r"\bam[eé]liore[rsz]?\b",
            r"\bnetto(?:yer|yage|ie|ies|iez)\b",
            r"\bm[eé]nage\b",
            r"\brestructure[rsz]?\b",
            r"\brenomm(?:er|e|es|ez|age)\b",
            r"\bsimplifi(?:er|e|es|ez|cation)\b",
            r"\boptimis(?:er|e|es|ez|ation)\b",
            r"\brefactor(?:ing)?\b",
            r"\bimprove(?:ment)?\b",
            r"\bclean(?:up)?\b",
            r"\brestructure\b",
            r"\brename\b",
            r"\bsimplify\b",
            r"\boptimize\b",
        ],
    ),
    (
        "review",
        1.1,
        [
            r"\breview(?:s|ed|ing|er)?\b",
            r"\baudit(?:s|er|e|ez)?\b",
            r"\banalys(?:e|er|es|ez|ons|is|ée?s?)\b",
            r"\banalyz(?:e|ed|ing)\b",
            r"\bv[eé]rifi(?:e|er|es|ez|ons|cation|é|ée)s?\b",
            r"\bverify\b|\bverification\b",
            r"\bcheck(?:s|ed|ing)?\b",
            r"\brelis(?:ez)?\b|\brelire\b",
            r"\bexamin(?:e|er|es|ez|ing)\b",
            r"\binspect(?:e|er|ez|ing)?\b",
            r"\bpasse en revue\b",
            r"\bregarde[rsz]?\b|\bregardons\b",
            r"\b[eé]tudi(?:e|er|es|ez)\b",
            r"\bcontr[oô]le[rz]?\b",
            r"\bfai(?:s|re) (?:le|un) point\b",
            r"\btake a look\b|\blook (?:at|into)\b",
        ],
    ),
    (
        "test",
        1.25,
        [
            r"\btests?\b",
            r"\bteste[rz]?\b|\btest(?:ing|ed)\b",
            r"\bpytest\b|\bunittest\b|\bplaywright\b",
            r"\bcouverture\b|\bcoverage\b",
            r"\br[eé]gressions?\b",
            r"\bfixtures?\b",
            r"\bla ci\b|\bci (?:passe|verte?)\b",
        ],
    ),
    (
        "docs",
        1.1,
        [
            r"\breadme\b",
            r"\bchangelog\b",
            r"\bdocstrings?\b",
            r"\bdocumentation\b",
            r"\b(?:la |le |une |un |cette |ce |dans (?:la |le |une |un )?)docs?\b",
            r"\bmarkdown\b",
            r"\bcommentaires?\b",
            r"\bfichiers? (?:de )?statu(?:s|ts?)\b",
            r"\bstatus files?\b",
            r"\bmets? (?:bien |aussi )?[aà] jour (?:le|la|les) (?:status|statuts?|fichiers?|docs?|notes?)\b",
            r"\bsauvegarde (?:le|la|les|cette) (?:status|statuts?|fichiers?|notes?|proc[eé]dures?)\b",
        ],
    ),
    (
        "ops",
        1.0,
        [
            r"\bcommit\w*\b",
            r"\bpush\w*\b",
            r"\bpull request\b|\bpull\b|\bprs?\b",
            r"\bmerge\w*\b|\bmerg[eé]e?s?\b",
            r"\bbranch(?:e|es)?\b",
            r"\brebase\w*\b",
            r"\bgit\b",
            r"\bclon(?:e|er|es|é|ée|ed|ing)\b",
            r"\bd[eé]ploi(?:e|er|es|ez|ement)s?\b|\bdeploy(?:s|ed|ing|ment)?\b|(?<!j'ai )(?<!j'avais )\bd[eé]ploy[eé]e?s?\b",
            r"(?<!j'ai )(?<!j'avais )\b(?:re)?lanc(?:e|er|es|ez|é|ée)\b[^\n.!?]{0,40}\b(?:script|run|workflow|pipeline|job|campagne|notebook|commande|build)\b",
            r"\bpubli(?:e|er|es|ez|é|ée|cation)\b|\bpublish(?:ed|ing)?\b",
            r"\brelease\b",
            r"\binstall(?:e[rz]?|es|ation|ed|ing)?\b",
            r"\bex[eé]cut(?:e|er|es|ez|ion)\b",
        ],
    ),
    (
        "question",
        1.0,
        [
            r"\bqu'est[- ]ce que\b",
            r"\bcomment\b",
            r"\bpourquoi\b",
            r"\bc'est quoi\b|\bc'est quel(?:le)?s?\b",
            r"\b[aà] quoi (?:ça |ca )?sert\b",
            r"\best[- ]ce qu(?:e|')",
            r"\bje (?:ne )?comprends? pas\b",
            r"\bqu'en penses?[- ]tu\b",
            r"\bdis[- ]m'en plus\b",
            r"\bil est o[uù]\b|\bo[uù] (?:est|sont)\b",
            r"\bquel(?:le)?s? (?:est|sont)\b",
            r"\bexpliqu(?:er|e|es|ez)\b",
            r"\bcompren(?:dre|ds?)\b",
            r"\bd[eé]cri(?:re?|s|t|vent|vons|vez)\b",
            r"\bque fait\b",
            r"\bdiff[eé]rences?\b",
            r"\bwhat (?:is|are|does)\b|\bwhat's\b",
            r"\bhow (?:do|can|does|to)\b",
            r"\bexplain\b",
            r"\bunderstand\b",
            r"\bdescribe\b",
            r"\btell me\b",
            r"\bdifference between\b",
            r"\bcan you (?:explain|describe|tell)\b",
        ],
    ),
    (
        "followup",
        1.5,
        [
            r"\btu (?:t'es|es|[eé]tais|[eé]tait|avais l'air|as l'air)\b[^.?!\n]{0,24}(?:bloqu|fig[eé]|plant[eé]|gel[eé])",
            r"\bencore (?:bloqu[eé]|fig[eé]|plant[eé])",
            r"^\s*reprend(?:s|re)?\b",
            r"^\s*recommence[rsz]?\b",
            r"^\s*continue[rsz]?\b",
        ],
    ),
    (
        "feedback",
        0.5,
        [
            r"\ben fait\b",
            r"\bplut[oô]t\b",
            r"\bpar contre\b",
            r"\bdu coup\b",
            r"\bfinalement\b",
            r"\b[aà] la place\b",
            r"\ben revanche\b",
            r"\bje pense\b",
            r"\b[aà] mon avis\b",
            r"\bje trouve\b",
            r"\bselon moi\b",
            r"\bje pr[eé]f[eè]re\b|\bj'aurais pr[eé]f[eé]r[eé]\b",
            r"\bj'ai chang[eé] d'avis\b",
            r"\b(?:vaudrait|vaut) mieux\b|\bce serait mieux\b|\bmieux vaut\b",
            r"\bpas convaincu\b",
            r"\bj'?aime pas\b|\bje n'aime pas\b",
            r"\bc'?est pas mal\b|\bpas mal mais\b",
            r"\btout est (?:bon|ok) (?:sauf|mais)\b",
            r"\b[cç]a (?:me )?(?:semble|para[iî]t) (?:bien|bon|ok)\b",
            r"\b[cç]a (?:ne )?change rien\b",
            r"\btoujours pareil\b",
            r"\bm[eê]me (?:probl[eè]me|chose|souci|qu'avant)\b",
            r"\bpas de changement\b",
            r"\brien (?:n'a |a )?chang[eé]\b",
            r"\binstead\b",
            r"\bactually\b",
            r"\bon second thought\b",
            r"\bi (?:think|prefer|feel)\b|\bi'd (?:prefer|rather)\b",
            r"\bchanged my mind\b",
            r"\bnot convinced\b",
            r"\b(?:looks|sounds) (?:good|fine) but\b|\bnot bad but\b",
            r"\bstill the same\b|\bno change\b",
            r"\balmost (?:there|right)\b|\bnot quite\b",
        ],
    ),
]
