"""The word lists and patterns that results depend on, in the order in which they apply."""

# Fixed value: titles of journals of the field.
ALLOWED_JOURNAL = '\\b(ophthalm|ophtalm|oftalm|augenheilk|augenärzt|cornea|corneal|eye|eyes|ocul|vision|vis(?:ual)?\\s*sci|optom|refract|cataract|kerato|retina|retinal|glaucoma|strabism|oculoplast|orbit|contact\\s+lens|klin(?:ische)?\\s+monatsbl|graefe|vestn(?:ik)?\\s+oftalm|arq(?:uivos)?\\s+bras(?:ileiros)?\\s+de\\s+oftalm|ocular\\s+surface|acta\\s+ophthalmol|jama\\s+ophthalmol|br(?:itish)?\\s+j(?:ournal)?\\s+ophthalmol|ganka|augen|oftalmol|ophtalmol)'

# Linking ISSNs of journals whose titles do not say so.
ALLOWED_ISSN = ['0004-2749', '0023-2165', '0042-465X', '0146-0404', '0721-832X', '1120-6721', '1367-0484', '1542-0124', '2164-2591']

# Journal stop-rules.
JOURNAL_STOPS = [('journal.plastic', '\\bplastic\\b'),
 ('journal.aesthetic', '\\baesthetic'),
 ('journal.rhinoplasty', '\\brhinoplast'),
 ('journal.reconstructive', '\\breconstructive surg'),
 ('journal.surgery_general', '\\bannals of surgery\\b'),
 ('journal.dental', '\\bdental\\b|\\bdentist|\\bdent\\b'),
 ('journal.oral', '\\boral\\b'),
 ('journal.maxillofacial', '\\bmaxillofac'),
 ('journal.orthodont', '\\borthodont'),
 ('journal.endodont', '\\bendodont'),
 ('journal.periodont', '\\bperiodont'),
 ('journal.biomaterials', '\\bbiomaterial'),
 ('journal.polymer', '\\bpolymer'),
 ('journal.hydrogel', '\\bhydrogel'),
 ('journal.tissue_eng', '\\btissue engineering\\b'),
 ('journal.wound', '\\bwound repair\\b|\\bwound care\\b|\\bwounds\\b'),
 ('journal.cartilage', '\\bcartilage\\b'),
 ('journal.bone', '\\bbone\\b|\\bbones\\b'),
 ('journal.spine', '\\bspine\\b|\\bspinal\\b'),
 ('journal.orthop', '\\borthop(?!t)'),
 ('journal.dermatol', '\\bdermatol'),
 ('journal.skin', '\\bskin\\b'),
 ('journal.vascular', '\\bvascular\\b'),
 ('journal.cardio', '\\bcardio'),
 ('journal.thoracic', '\\bthoracic\\b'),
 ('journal.urology', '\\burolog'),
 ('journal.gyn', '\\bgyn(?:a)?ecol|\\bobstet'),
 ('journal.hepatol', '\\bhepatol'),
 ('journal.gastro', '\\bgastroenter'),
 ('journal.neurosurg', '\\bneurosurg'),
 ('journal.neurol', '\\bneurol(?!.*ophthalm)'),
 ('journal.psychiatr', '\\bpsychiatr'),
 ('journal.oncol', '\\boncol'),
 ('journal.hematol', '\\bh(?:a)?ematol'),
 ('journal.endocrinol', '\\bendocrinol'),
 ('journal.nephrol', '\\bnephrol'),
 ('journal.pulmonol', '\\bpulmonol|\\brespirat')]

# Subject-heading stop-rules.
MESH_STOPS = [('mesh.rhinoplasty', '^rhinoplasty$'),
 ('mesh.plastic_surgery', '^surgery, plastic$|^plastic surgery'),
 ('mesh.reconstructive', '^reconstructive surgical procedures$'),
 ('mesh.skin_transplant', '^skin transplantation$'),
 ('mesh.cartilage', '^cartilage'),
 ('mesh.bone', '^bone and bones$|^bone '),
 ('mesh.dental', '^dental |^dentin$|^tooth|^periodont|^orthodont'),
 ('mesh.tissue_scaffolds', '^tissue scaffolds$|^tissue engineering$'),
 ('mesh.cardiovascular', '^cardiovascular|^aorta'),
 ('mesh.blood_vessels', '^blood vessels$')]

# Fixed value: headings of the eye.
OCULAR_MESH = ('^(cornea|corneal|keratocon|keratitis|keratectas|eye\\b|ocular|ophthalm|vision|visual acuity|refractive|dilatation, pathologic|contact '
 'lens|photorefractive|keratomileusis|keratectomy|myopia|hyperopia|astigmatism|presbyopia|refractive errors|refractive surgical|corneal surgery|riboflavin|cross-linking '
 'reagents|photochemotherapy|photosensitizing)')

# Fixed value: terms of the procedures.
SIGNAL = ('\\b(lasik|femto-?lasik|fs-?lasik|sbk|laser in situ keratomileusis|laser-assisted in situ keratomileusis|keratomileusis|photorefractive keratectom\\w*|prk|lasek|epi-?lasik|laser '
 '(?:sub)?epithelial keratomileusis|surface ablation|advanced surface ablation|laser[\\s-]assisted subepithelial keratectomy|small[\\s-]incision lenticule extraction|lenticule '
 'extraction|refractive lenticule|smile|relex|flex|klex|smartsight|clear procedure|trans-?prk|transepithelial (?:photorefractive|prk|surface)|laser vision correction|laser '
 'refractive|corneal refractive surgery|keratorefractive|refractive '
 'surgery|excimer|wavefront[\\s-](?:guided|optimi[sz]ed)|topography[\\s-]guided|presbylasik|presbyond|microkeratome|femtosecond laser flap|lasik flap|flap creation|refractive '
 '(?:laser|ablation)|intracor|intrastromal femtosecond|small incision lens extraction)\\b')

# Fixed value: terms of the field.
FIELD_TERM = ('\\b(cornea|corneal|corneas|keratocon|ectasi|ectatic|keratitis|keratocyte|stroma|stromal|keratometr|pachymetr|topograph|tomograph|scheimpflug|visual '
 'acuity|slit[\\s-]?lamp|intraocular|ophthalm|ocular|\\beye\\b|\\beyes\\b|retina|lasik|photorefractive|refractive(?!\\s+ind(?:ex|ices))|myopi\\w*|hyperop\\w*|astigmat\\w*|presbyop\\w*|ametrop\\w*|endotheli|epitheli|limb(?:us|al)|conjunctiv|sclera|dry '
 'eye|tear film|diopt\\w*|aberration|vision|eyeglass\\w*|spectacle\\w*|glasses)')

# Fixed value: procedures named beyond doubt.
NAMED_PROCEDURE = ('\\b(lasik|femto-?lasik|laser in situ keratomileusis|laser-assisted in situ keratomileusis|photorefractive keratectom\\w*|lasek|epi-?lasik|laser (?:sub)?epithelial '
 'keratomileusis|small[\\s-]incision lenticule extraction|lenticule extraction|relex|klex|smartsight|trans-?prk|laser vision correction|laser refractive surg\\w*|corneal '
 'refractive surg\\w*|keratorefractive surg\\w*|presbylasik|presbyond)\\b')

# Fixed value: headings of the procedures.
MESH_SIGNAL = '^keratomileusis, laser in situ$|^photorefractive keratectomy$|^keratectomy, subepithelial, laser-assisted$|^corneal surgery, laser$|^refractive surgical procedures$'

# Fixed value: the therapeutic procedure.
THERAPEUTIC = '\\b(phototherapeutic keratectom\\w*|ptk)\\b'

# Fixed value: refractive terms apart from the laser.
REFRACTIVE = ('\\b(lasik|keratomileusis|photorefractive|prk|lasek|subepithelial keratectomy|lenticule|smile|relex|klex|refractive surg\\w*|laser vision '
 'correction|myopi\\w*|hyperop\\w*|astigmat\\w*|refractive error)\\b')

# Procedure families.
FAMILIES = {'LASIK': "\\b(lasik|fs-?lasik|femto-?lasik|sbk|sub-?bowman'?s? keratomileusis|laser[\\s-](?:assisted )?in situ keratomileusis|keratomileusis, laser in situ)\\b",
 'Surface ablation': '\\b(photorefractive keratectom\\w*|prk|t-?prk|trans-?prk|lasek|epi-?lasik|laser[\\s-](?:assisted )?(?:sub)?epithelial keratomileusis|keratectomy, '
                     'subepithelial, laser-assisted|surface ablation|transepithelial (?:photorefractive|surface))\\b',
 'Lenticule extraction': '\\b(smile|relex|flex|klex|smartsight|lenticule extraction|small[\\s-]incision lenticule|keratorefractive lenticule|femtosecond lenticule|smooth incision '
                         'lenticular keratomileusis|silk)\\b'}

# Fixed value: context that makes an ambiguous word the procedure.
LENTICULE_CONTEXT = 'lenticul|relex|small[\\s-]incision|klex|visumax'

# Rewrites before a keyword is looked up.
KEYWORD_REWRITES = [('\\bcross[\\s-]?link(ing|ed|s)?\\b', 'cross-linking'),
 ('\\bcrosslink(ing|ed|s)?\\b', 'cross-linking'),
 ('\\btrans[\\s-]?epithelial\\b', 'transepithelial'),
 ('\\bepi(?:thelium|thelial)?[\\s-]?on\\b', 'epi-on'),
 ('\\bepi(?:thelium|thelial)?[\\s-]?off\\b', 'epi-off'),
 ('\\b(?:ultraviolet|uv)[\\s-]?a\\b', 'uva'),
 ('\\bultra[\\s-]?violet\\b', 'ultraviolet'),
 ('\\ba[\\s-]?cxl\\b', 'accelerated cxl'),
 ('\\bpack[\\s-]?cxl\\b', 'pack-cxl'),
 ('\\bkerato?c[oô]ne?\\b|\\bqueratocono\\b|\\bcheratocono\\b|\\bkeratokonus\\b', 'keratoconus'),
 ('\\bcornee\\b|\\bcornea\\b', 'cornea'),
 ('\\bp(?:a)?ediatric\\b', 'paediatric'),
 ('\\((cxl|kc|uva|prk|oct)\\)', '\\1')]

# Words that keep their final s.
SINGULAR_EXCEPTIONS = ['analysis',
 'apoptosis',
 'as',
 'cornea',
 'diabetes',
 'ectasis',
 'genesis',
 'hydrops',
 'hysteresis',
 'iris',
 'is',
 'keratitis',
 'keratoconus',
 'lens',
 'mitosis',
 'os',
 'ptosis',
 'sclera',
 'series',
 'sis',
 'stroma',
 'us',
 'uveitis']

# Keyword families and their names.
KEYWORD_FAMILIES = [('^(?:(?:femtosecond|femto|fs)[\\s-]?(?:laser[\\s-])?(?:assisted )?)?(?:lasik|laser[\\s-](?:assisted )?in situ keratomileusis)(?: '
  '\\(?(?:fs-)?lasik\\)?)?$|^(?:fs|femto|femtosecond)-?lasik$|^femtosecond laser in situ keratomileusis$|^sbk$|^sub-bowman keratomileusis$|^laser in situ keratomileusis '
  'surgery$|^keratomileusis, laser in situ$',
  'LASIK'),
 ('^(?:transepithelial|trans-?epithelial|single[\\s-]step transepithelial|one[\\s-]step transepithelial)(?: photorefractive keratectomy| prk| surface ablation)(?: '
  '\\(?t-?prk\\)?)?$|^t-?prk$|^trans-?prk$|^ss-?t-?prk$|^streamlight$',
  'transepithelial PRK'),
 ('^(?:photorefractive keratectom(?:y|ies))(?: \\(?prk\\)?)?$|^prk$|^excimer laser photorefractive keratectomy$|^photorefractive keratectomy, excimer laser$',
  'photorefractive keratectomy (PRK)'),
 ('^lasek$|^laser[\\s-](?:assisted )?(?:sub)?epithelial keratomileusis(?: \\(?lasek\\)?)?$|^epi-?lasik$|^epipolis lasik$', 'LASEK / epi-LASIK'),
 ('^(?:advanced )?surface ablation$|^asa$', 'surface ablation'),
 ('^(?:femtosecond )?small[\\s-]incision lenticule extraction(?: \\(?smile\\)?)?$|^smile(?: pro)?$|^relex(?: smile)?$|^refractive lenticule extraction(?: '
  '\\(?relex\\)?)?$|^keratorefractive lenticule extraction(?: \\(?klex\\)?)?$|^klex$|^femtosecond lenticule extraction(?: \\(?flex\\)?)?$|^lenticule '
  'extraction$|^smartsight$|^clear$|^corneal lenticule extraction for advanced refractive correction$',
  'lenticule extraction (SMILE/KLEx)'),
 ('^(?:corneal |laser |keratorefractive |laser corneal )?refractive surg(?:ery|ical procedures?)$|^refractive surgical procedure$|^keratorefractive surgery$|^laser vision '
  'correction$|^laser refractive correction$|^corneal refractive procedure$',
  'refractive surgery'),
 ('^wavefront[\\s-]guided(?: ablation| treatment| lasik| prk)?$', 'wavefront-guided ablation'),
 ('^wavefront[\\s-]optimi[sz]ed(?: ablation| treatment)?$', 'wavefront-optimized ablation'),
 ('^topography[\\s-]guided(?: ablation| treatment| lasik| prk| photorefractive keratectomy)?$|^contoura(?: vision)?$|^t-cat$', 'topography-guided ablation'),
 ('^presby-?lasik$|^presbyond$|^laser blended vision$|^intracor$|^presbyopia correction$', 'laser presbyopia correction'),
 ('^(?:femtosecond|fs|femto)(?: laser)?s?$|^femtosecond laser technology$', 'femtosecond laser'),
 ('^excimer(?: laser)?s?$|^excimer laser ablation$', 'excimer laser'),
 ('^(?:high |low |moderate |extreme |pathologic )?myopi(?:a|c)$|^myopic eyes?$', 'myopia'),
 ('^(?:myopic |hyperopic |mixed |high |irregular |residual |corneal )?astigmatism$', 'astigmatism'),
 ('^(?:high )?hyperopi(?:a|c)$|^hypermetropia$', 'hyperopia'),
 ('^presbyopi(?:a|c)$', 'presbyopia'),
 ('^refractive errors?$|^ametropia$', 'refractive error'),
 ('^(?:higher|high)[\\s-]order aberrations?(?: \\(?hoas?\\)?)?$|^hoas?$|^(?:ocular |corneal |optical |wavefront )?aberrations?$|^wavefront aberrations?$',
  'higher-order aberrations'),
 ('^dry eyes?(?: disease| syndrome)?(?: \\(?ded\\)?)?$|^keratoconjunctivitis sicca$|^post-?(?:lasik|refractive surgery) dry eye$', 'dry eye'),
 ('^(?:corneal )?haze$|^subepithelial haze$', 'corneal haze'),
 ('^diffuse lamellar keratitis(?: \\(?dlk\\)?)?$|^dlk$', 'diffuse lamellar keratitis'),
 ('^epithelial ingrowth$', 'epithelial ingrowth'),
 ('^mitomycin[\\s-]?c?$|^mmc$', 'mitomycin C'),
 ('^post-?(?:lasik|refractive(?: surgery)?|surgical|smile|prk|keratorefractive) (?:corneal )?ectasia$|^(?:iatrogenic|secondary) (?:corneal )?ectasia$|^ectasia after '
  '(?:lasik|refractive surgery|laser in situ keratomileusis|smile|prk)$|^(?:corneal )?ectasia$|^keratectasia$|^corneal ectasias$',
  'corneal ectasia'),
 ('^(?:subclinical |forme fruste |progressive )?keratoconus$|^kc$', 'keratoconus'),
 ('^(?:corneal )?(?:collagen )?cross-linking(?: \\(?cxl\\)?)?$|^(?:corneal )?cxl$|^accelerated cross-linking$', 'corneal cross-linking (CXL)'),
 ('^(?:corneal )?biomechanic\\w*$|^corneal hysteresis$|^ocular response analy[sz]er$|^corvis(?: st)?$|^brillouin microscopy$', 'corneal biomechanics'),
 ('^(?:corneal )?topography$|^videokeratograph\\w*$|^placido(?: disc| disk)?(?: topography)?$', 'corneal topography'),
 ('^(?:corneal )?tomography$|^scheimpflug(?: imaging| camera| tomography)?$|^pentacam(?: hr)?$', 'corneal tomography'),
 ('^(?:anterior segment )?(?:optical coherence tomography|oct)$|^as-oct$', 'optical coherence tomography (OCT)'),
 ('^(?:intraocular lens|iol) power(?: calculation)?$|^iol calculation$|^intraocular lens power calculation$', 'IOL power calculation'),
 ('^implantable collamer lens(?: \\(?icl\\)?)?$|^icl$|^phakic (?:intraocular lens|iol)(?:es|s)?$|^implantable contact lens$', 'phakic IOL / ICL'),
 ('^(?:infectious|fungal|bacterial|microbial|mycobacterial) keratitis$', 'infectious keratitis'),
 ('^artificial intelligence(?: \\(?ai\\)?)?$|^ai$', 'artificial intelligence'),
 ('^machine learning$', 'machine learning'),
 ('^deep learning$|^convolutional neural network\\w*$|^cnn$', 'deep learning')]

# Generational suffixes.
NAME_SUFFIXES = ['filho', 'jr', 'junior', 'júnior', 'neto', 'senior', 'sobrinho', 'sr']

# Surnames so common that initials tell nobody apart.
COMMON_SURNAMES = ['agarwal',
 'cao',
 'chen',
 'cho',
 'choi',
 'deng',
 'feng',
 'gao',
 'gupta',
 'han',
 'he',
 'hong',
 'huang',
 'ito',
 'jang',
 'joshi',
 'jung',
 'kang',
 'kato',
 'kim',
 'kobayashi',
 'kumar',
 'kwon',
 'lee',
 'li',
 'liang',
 'lim',
 'lin',
 'liu',
 'luo',
 'ma',
 'mehta',
 'mishra',
 'moon',
 'nair',
 'nakamura',
 'oh',
 'park',
 'patel',
 'pillai',
 'reddy',
 'sasaki',
 'sato',
 'seo',
 'shah',
 'sharma',
 'shin',
 'singh',
 'sun',
 'suzuki',
 'takahashi',
 'tanaka',
 'tang',
 'wang',
 'watanabe',
 'wei',
 'wu',
 'xiao',
 'xie',
 'xu',
 'yamada',
 'yamamoto',
 'yang',
 'ye',
 'yoon',
 'yoshida',
 'zhang',
 'zhao',
 'zheng',
 'zhou',
 'zhu']

# Where an affiliation names its institution, in order.
INSTITUTION_KEYS = ['(\\b\\w+(?:\\s+\\w+)?)\\s+university',
 'university\\s+of\\s+(\\w+(?:\\s+\\w+)?)',
 '(\\b\\w+)\\s+eye\\s+(?:hospital|institute|centre|center)',
 '(\\b\\w+)\\s+(?:medical|ophthalmology)\\s+(?:center|centre|hospital)',
 '(elza|moorfields|bascom\\s+palmer|wills\\s+eye|noor|aravind|sankara|lv\\s+prasad|l\\.v\\.\\s*prasad|narayana\\s+nethralaya|iroc)',
 ',\\s*([a-z\\s]{4,20}),\\s*(?:china|japan|korea|india|iran|taiwan)']

# Words that identify no institution.
KEY_STOPWORDS = ['a',
 'affiliated',
 'an',
 'and',
 'at',
 'das',
 'de',
 'del',
 'della',
 'der',
 'des',
 'di',
 'die',
 'for',
 'from',
 'in',
 'la',
 'le',
 'medical',
 'national',
 'normal',
 'of',
 'state',
 'technical',
 'technological',
 'the',
 'to',
 'with']

# How parts of institutions begin.
DEPARTMENT_STARTS = ['department',
 'dept',
 'division',
 'unit',
 'section',
 'laboratory',
 'lab ',
 'service',
 'clinic for',
 'faculty',
 'school of',
 'college of',
 'institute of',
 'center for',
 'centre for',
 'program',
 'programme',
 'group',
 'abteilung',
 'klinik für',
 'klinik fur',
 'augenklinik',
 'universitäts-augenklinik',
 'servicio',
 'departamento',
 'dipartimento',
 'clinica',
 "service d'",
 'unité',
 'u.o.']

# Words of institutions.
INSTITUTION_WORDS = ['university',
 'universität',
 'universitat',
 'université',
 'universidad',
 'universidade',
 'università',
 'universita',
 'hospital',
 'hôpital',
 'hopital',
 'ospedale',
 'krankenhaus',
 'klinikum',
 'institute',
 'institut',
 'instituto',
 'college',
 'eye center',
 'eye centre',
 'eye hospital',
 'medical center',
 'medical centre',
 'clinic',
 'foundation',
 'academy',
 'infirmary',
 'nethralaya',
 'policlinico',
 'azienda',
 'ircc']

# Names that identify no institution.
GENERIC_NAMES = ['augenabteilung',
 'augenheilkunde',
 'college of medicine',
 'department of ophthalmology',
 'division of clinical neuroscience',
 'faculty of medicine',
 'institute of biochemical and biomedical engineering',
 'medical school',
 'research institute of eye diseases',
 'school of medicine',
 'school of optometry']

# Segments that are countries.
COUNTRY_WORDS = ['australia',
 'austria',
 'belgium',
 'brazil',
 'canada',
 'china',
 'egypt',
 'france',
 'germany',
 'greece',
 'india',
 'iran',
 'israel',
 'italy',
 'japan',
 'netherlands',
 'south korea',
 'spain',
 'switzerland',
 'turkey',
 'uk',
 'usa']

# The parts of the search, as patterns; the last one counts where no phrase before it does.
QUERY_ARMS = [
    ("corneal_cxl_phrase", r"corneal (collagen )?cross[\s-]?link"),
    ("collagen_cxl_phrase", r"collagen cross[\s-]?link"),
    ("stromal_cxl", r"stromal cross[\s-]?link"),
    ("CXL_abbrev", r"\b(a-?cxl|pack-cxl|cxl)\b"),
    ("epi_on_off", r"\bepi(?:thelium)?-?(on|off)\b"),
    ("riboflavin_uv", r"(?s)riboflavin.{0,120}(ultraviolet|uv-?a\b|uv a\b)|(ultraviolet|uv-?a\b).{0,120}riboflavin"),
    ("photoactivated_chromophore", r"photoactivated chromophore"),
    ("KXL_C3R", r"\b(kxl|c3-r)\b"),
    ("bare_crosslink+disease", r"cross[\s-]?link"),
]
STRONG_ARMS = ["corneal_cxl_phrase", "collagen_cxl_phrase", "stromal_cxl"]
WEAK_ARM, MESH_ARM = "bare_crosslink+disease", ("mesh_CXL", "Corneal Cross-Linking")
