"""Built-in store rules: which identifiers the URLs of known stores carry.

Everything in STORES is a set of fixed values (store ids, domains, URL patterns). A user replaces or extends it by
passing another rules table to ``cartloom.sources.registry``.

Row form: (store id or None, domain, path patterns, query patterns, options). Patterns run over lower-cased paths and
queries. Options: ``aliases`` as (id, domain) pairs; ``rewrite`` as (find, replacement), applied once to every id a path
pattern yields.
"""

from __future__ import annotations

# Store rules, in lookup order.
STORES = [
    ("5246", "target.com", [r"\ba-(\d{6,24})\b"], [], {}),
    ("9528", "nike.com", [r"/(\w{6,16}-\w{3})\b"], [], {}),
    ("4207", "ulta.com", [r"\b((?:pimprod|xlsimpprod|\d){6,24})(?:$|\b)"], [], {}),
    ("8378", "qvc.com", [r"\bproduct\.(\w{6,24})\.html"], [], {}),
    ("2524", "zappos.com", [r"/asin/(\w{6,24})(?:$|\b)"], [], {}),
    ("2946", "walmart.com", [r"/ip/[\w-]+/(\d{6,24})(?:$|\b)"], [], {}),
    ("10086", "samsclub.com", [r"/(?:ip|p)/[\w-]+/(\w{6,24})(?:$|\b)"], [], {"rewrite": ("^(?:prod|p)", "")}),
    (
        "3864",
        "gap.com",
        [],
        [],
        {
            "aliases": [
                ("13943", "gapfactory.com"),
                ("3726", "oldnavy.gap.com"),
                ("9311", "bananarepublic.gap.com"),
                ("15061", "bananarepublicfactory.gapfactory.com"),
                ("10168", "athleta.gap.com"),
            ]
        },
    ),
    ("12205", "saksoff5th.com", [r"\b(\d{6,24})\.html"], [], {}),
    ("13467", "hm.com", [r"\bproductpage\.(\d{6,16})\.html"], [], {}),
    ("16788", "chewy.com", [r"\bdp/(\w{6,24})\b"], [], {}),
    ("9141", "anntaylor.com", [r"\bgrp_(\d{4,16})_\d{1,8}\.html", r"\bgrp_([\d_]{4,16})\.html"], [], {}),
    ("9205", "love-scent.com", [r"\b(p-\d{1,16})\.html"], [], {"rewrite": ("p-", "sku-")}),
    ("13482", "ikea.com", [r"\b(\w{1,16})$"], [], {"rewrite": ("s", "")}),
    ("20571", "magneticme.com", [r"/([\w-]{4,24})$"], [], {"rewrite": ("_", "-")}),
    ("16008", "mountainwarehouse.com", [r"-p(\d{4,16})\.aspx"], [], {}),
    ("9898", "labseries.com", [r"/product/\d+/(\d{4,16})/"], [], {}),
    ("22077", "theinside.com", [r"\b(\d{5,16})$"], [], {}),
    (None, "smashbox.com", [r"\bproduct/\d+/(\d{5,16})/"], [], {}),
    ("14393", "rockyboots.com", [r"\b(\w{1,24})\.html", r"/(\w{1,5}\d{3,8})(?:_|$|\b)"], [], {}),
    ("4690", "maidenform.com", [r"/(\w{5,24})$"], [], {}),
    ("16522", "kathykuohome.com", [r"\bproduct/detail/(\d{3,24})\b"], [], {}),
    ("16274", "fairwaygolfusa.com", [r"\bpid/(\d{3,24})$"], [], {}),
    ("18859", "drmartens.com", [r"\bp/(\w{5,24})$"], [], {}),
    ("4489", "famousfootwear.com", [r"-(\d{5,24})/\b", r"\b(\d{5,24})$"], [], {}),
    ("10269", "care.com", [r"\b(\d{4,24})-"], [], {}),
    ("9428", "ae.com", [r"(?:/p/|\b)([\d_]{4,24})$"], [], {}),
    ("12539", "zoro.com", [r"\b(\w{5,24})$"], [], {}),
    ("9847", "westelm.com", [r"-(\w{5,24})$"], [], {}),
    ("13957", "uniqlo.com", [r"\bproducts/([\w-]{5,24})/"], [], {}),
    ("2302", "rei.com", [r"\bproduct/(\d{5,24})/"], [], {}),
    ("4227", "dickssportinggoods.com", [r"/(\w{4,24})$"], [], {}),
    ("10408", "crateandbarrel.com", [r"/s(\w{4,24})$"], [], {}),
    ("4767", "bestbuy.com", [r"\b(\d{4,24})\.p$"], [], {}),
    ("5487", "adidas.com", [r"\b(\w{6,24})\.html"], [], {}),
    ("10180", "katespade.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("3827", "journeys.com", [r"-(\d{4,24})$"], [], {}),
    ("977", "josbank.com", [r"-(\w{4,24})$"], [], {}),
    ("69", "jcpenney.com", [r"/product/(\w{4,24})$"], [], {}),
    ("11377", "kirklands.com", [r"\b(\d{6,24})\.uts"], [], {}),
    ("8031", "rugsusa.com", [r"\b([\w-]{6,24})\.html"], [], {}),
    ("16000", "funko.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("22484", "loungefly.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("11973", "iherb.com", [r"\b(\d{5,24})$"], [], {}),
    ("24779", "houzz.com", [r"\b(\d{5,24})$"], [], {}),
    ("7646", "harryanddavid.com", [r"\b(\d{5,24})$"], [], {}),
    ("12621", "golfgalaxy.com", [r"\b(\w{5,24})$"], [], {}),
    ("10228", "discountschoolsupply.com", [r"\bp/(\w{4,24})$"], [], {}),
    (None, "cuisinart.com", [r"\b([\w-]{4,24})\.html"], [], {}),
    (None, "healthypets.com", [r"\b(\d{5,24})\.html"], [], {}),
    ("19196", "circusny.com", [r"(?:\b|-)(\w{5,24})$"], [], {}),
    ("8933", "childrensplace.com", [r"-(\d{5,24}-\w{2,24})$"], [], {}),
    ("10657", "harborfreight.com", [r"\b(\d{5,24})\.html"], [], {}),
    ("9609", "champssports.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("16829", "cos.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("16829", "costco.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("19490", "acmemarkets.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("2144", "charlestyrwhitt.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("10530", "teva.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("18125", "stories.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("16349", "baggallini.com", [r"\b([\w-]{2,24})\.html"], [], {}),
    ("20026", "arlo.com", [r"\b([\w-]{5,24})\.html"], [], {}),
    ("20040", "savagex.com", [r"([a-z]{2,3}\d{7,10}-\d{3,5})\b", r"([a-z]{4,6}\d{6,10})\b"], [], {}),
    ("21176", "temu.com", [r"-g-(\d{10,20})(?:$|/)"], [r"goods_id=(\d{10,20})\b", r"sku_id=(\d{10,20})\b"], {}),
    ("9728", "underarmour.com", [r"\b(\d{12,13})\.html"], [], {}),
    ("12514", "talbots.com", [r"\b(\d{7,8})\.html"], [], {}),
    ("9142", "loft.com", [r"\b(\d{8})\.html"], [], {}),
    ("21288", "thriftbooks.com", [r"isbn=(\d{10,13})"], [], {}),
    ("18916", "coachoutlet.com", [], [r"pid=(\w{3,30})(?:&|$)"], {}),
    ("11433", "therealreal.com", [r"-([a-z\d]{5})$"], [], {}),
    ("9350", "zazzle.com", [r"-(\d{15,20})(?:\b|\?|$)"], [r"pd=(\d{15,20})\b"], {}),
    ("12028", "anthropologie.com", [r"an-(\d{10,15}-\d{1,5})(?:\b|/|\?|$)"], [], {}),
    (
        "12323",
        "woot.com",
        [r"-(\d{1,2})(?:$|\?)"],
        [],
        {
            "aliases": [
                ("12323", "sellout.woot.com"),
                ("12323", "tools.woot.com"),
                ("12323", "sport.woot.com"),
                ("12323", "shirt.woot.com"),
                ("12323", "electronics.woot.com"),
                ("12323", "home.woot.com"),
                ("12323", "computers.woot.com"),
            ]
        },
    ),
    ("10802", "wayfair.com", [r"\b(\w{5,24})\.html"], [], {}),
    ("22489", "lodgecastiron.com", [r"\b([\w-]{4,24})\.html"], [], {}),
    ("8442", "stacyadams.com", [r"\b([\w-]{4,24})\.html"], [], {}),
    ("15159", "1stoplighting.com", [r"_([\w-]{1,24})\.htm"], [], {}),
    ("6326", "lillianvernon.com", [r"\b(\w{4,24})\.html"], [], {}),
    ("9443", "kiehls.com", [r"\b(\w{3,24})\.html"], [], {}),
    ("8380", "lampsplus.com", [r"__(\w{4,24})\.html"], [], {}),
    ("16449", "campchef.com", [r"\b([\w-]{4,24})\.html"], [], {}),
    ("14991", "boohooman.com", [r"\b([\w-]{4,24})\.html"], [], {}),
    ("10904", "haggar.com", [r"\b(\d{4,24})\.html"], [], {}),
    ("19546", "dancewearsolutions.com", [r"\b(\d{4,24})\.aspx"], [], {}),
    ("24127", "overstock.com", [r"\b(\d{4,24})/product\.html"], [], {}),
    ("10722", "lowes.com", [r"\b(\d{4,24})$"], [], {}),
    ("3865", "jcrew.com", [r"\bp/(\w{4,24})$"], [], {}),
    (
        "15861",
        "gymshark.com",
        [],
        [],
        {
            "aliases": [
                ("15861", "us.shop.gymshark.com"),
                ("15861", "ca.gymshark.com"),
                ("15861", "uk.gymshark.com"),
                ("15861", "au.gymshark.com"),
                ("15861", "de.gymshark.com"),
                ("15861", "fr.gymshark.com"),
            ]
        },
    ),
    ("10752", "carters.com", [r"/(v_\w{6,12})(?:$|\.html|\b)"], [], {}),
    (
        "7206",
        "kohls.com",
        [r"/product/(prd-\d{6,12})/", r"/product/prd-(\d{6,12})/"],
        [],
        {"aliases": [("7206", "m.kohls.com")]},
    ),
    ("8302", "acehardware.com", [r"/product/(\w{4,12})(?:$|\b)"], [r"variationproductcode=(\d{4,12})\b"], {}),
    (
        None,
        "test-search.example.com",
        [r"\btest-(\d{6,})\b"],
        [r"\[\?&\]productId=(\w{6,24})\b", r"\[\?&\]sku=([\w-]{4,24})\b"],
        {},
    ),
    ("13349", "nordstromrack.com", [r"/s/(\d{4,})(?:/|$)"], [], {}),
    ("10437", "columbia.com", [r"-([a-z\d]{6,15})(?:\.html|_)"], [], {}),
    ("3866", "landsend.com", [r"/id_(\d{5,8})", r"/pp/stylepage-(\d{5,8})_"], [], {}),
    (
        "98",
        "disneystore.com",
        [r"-([a-z\d]{9,16})\.html"],
        [],
        {"aliases": [("98", "shopdisney.com")]},
    ),
    ("9", "dell.com", [r"/apd/([\w-]{6,20})(?:/|$)", r"/spd/[\w-]+/(\w{6,30})(?:/|$)"], [], {}),
]
