"""Word lists of the detectors, as plain text: one list to a name, terms divided by commas."""

from __future__ import annotations

import re


def _terms(text: str) -> tuple[str, ...]:
    return tuple(" ".join(t.split()) for t in text.split(","))


def _table(text: str) -> dict[str, str]:
    """Lines of `value: term, term`."""
    out = {}
    for line in text.strip().splitlines():
        value, _, terms = line.partition(": ")
        out |= dict.fromkeys(_terms(terms), value.strip())
    return out


# Results depend on exactly these words.

GIVEN_NAMES = _terms("""
juan, jose, luis, carlos, jorge, miguel, pedro, antonio, manuel, francisco, javier, andres, diego, david, daniel,
sergio, alberto, ricardo, fernando, rafael, eduardo, oscar, raul, victor, hector, julio, mario, ruben, ivan, camilo,
santiago, sebastian, nicolas, mateo, samuel, felipe, esteban, maria, ana, laura, carmen, rosa, isabel, patricia,
claudia, sandra, monica, adriana, diana, paola, andrea, carolina, natalia, lucia, elena, marta, beatriz, sofia,
valentina, gabriela, daniela, alejandra, veronica, silvia, julia, clara, martha, gloria, yolanda, amparo, consuelo,
esperanza, olga, alejandro, gustavo, hernan, alvaro, arturo, ramon, cesar, emilio, ignacio, lorenzo, marcos, pablo,
rodrigo, tomas, vicente, guillermo, leonardo, mauricio, orlando, wilson
""")

SURNAMES = _terms("""
garcia, rodriguez, gonzalez, fernandez, lopez, martinez, sanchez, perez, gomez, martin, jimenez, ruiz, hernandez,
diaz, moreno, alvarez, munoz, romero, alonso, gutierrez, navarro, torres, dominguez, vazquez, ramos, gil, ramirez,
serrano, blanco, molina, morales, suarez, ortega, delgado, castro, ortiz, rubio, marin, sanz, nunez, iglesias, medina,
garrido, cortes, castillo, santos, lozano, guerrero, cano, prieto, mendez, cruz, herrera, pena, flores, cabrera,
campos, vega, fuentes, carrasco, diez, caballero, reyes, rico, quintero, arias, acosta, rojas, cardenas, bermudez
""")

PARTICLES = _terms("""
de, del, la, las, los, van, von, da, di
""")

DEPARTMENTS = _terms("""
antioquia, cundinamarca, valle del cauca, atlantico, santander, bolivar, narino, cauca, tolima, huila, caldas,
risaralda, quindio, meta, cesar, cordoba, magdalena, boyaca, sucre
""")

INSTITUTIONS = _terms("""
hospital universitario, hospital, centro clinico, centro medico, centro de salud, centro de diagnostico, clinica,
policlinico, sanatorio, instituto, fundacion, laboratorio clinico, laboratorio, ips, eps, unidad medica, consultorio
""")

INSURERS = _terms("""
sura, sanitas, compensar, famisanar, nueva eps, salud total, coomeva, medimas, colsanitas, colmedica, seguros bolivar,
adres, sisben, imss, issste, essalud, fonasa, osde, adeslas, asisa, dkv, mapfre salud
""")

ANATOMY = _terms("""
colon, ascendente, descendente, transverso, sigmoide, recto, ciego, ileon, yeyuno, duodeno, estomago, esofago, higado,
vesicula, pancreas, bazo, rinon, rinones, vejiga, uretra, prostata, utero, ovario, ovarios, mama, mamas, pulmon,
pulmones, bronquio, traquea, corazon, aorta, arteria, vena, cerebro, cerebelo, tronco, medula, hipofisis, tiroides,
paratiroides, suprarrenal, piel, musculo, hueso, femur, tibia, humero, radio, cubito, clavicula, escapula, vertebra,
lumbar, cervical, toracico, sacro, cadera, rodilla, tobillo, hombro, codo, muneca, mano, pie, abdomen, torax, pelvis,
cuello, craneo, orbita, seno, senos, ganglio, ganglios, peritoneo, pleura, pericardio, mediastino, apendice, amigdala,
faringe, laringe, retina, cornea, timpano, hepatico, renal, pulmonar, gastrico, colonico, rectal, biliar, esplenico,
pancreatico, ileocecal, hepatica, hepaticos, mucosa, submucosa
""")

LATERALITY = _terms("""
derecho, derecha, izquierdo, izquierda, bilateral, unilateral, proximal, distal, superior, inferior, anterior,
posterior, medial, lateral, ipsilateral, contralateral
""")

NEGATIONS = _terms("""
no, sin, niega, ausencia, ausente, negativo, negativa, descarta, descartado, descartada, nunca, tampoco
""")

CERTAINTY = _terms("""
probable, posible, sugestivo, sugestiva, compatible, sospecha, sospechoso, aparente, confirmado, confirmada,
definitivo, presuntivo, presuntiva, descartar, indeterminado, dudoso
""")

UNITS = _terms("""
mg/dl, g/dl, mmol/l, mol/l, meq/l, ui/l, u/l, ng/ml, pg/ml, ug/ml, mcg/ml, mg/l, g/l, mm/h, mmhg, cmh2o, lpm, rpm,
kg/m2, mg/m2, mg/kg, mcg/kg/min, ml/min, ml/h, gotas/min, celulas/ul, x10e3/ul, x10e6/ul, 10^3/ul, 10^6/ul, /ul, /mm3,
kg, mg, mcg, ug, ml, dl, cm, mm, cc, bpm, ui, meq, mmol, g, l, m, %
""")

ANALYTES = _terms("""
hemoglobina, hematocrito, leucocitos, neutrofilos, linfocitos, plaquetas, glucosa, glicemia, creatinina, urea, bun,
sodio, potasio, cloro, calcio, magnesio, fosforo, bilirrubina, ast, alt, got, gpt, fosfatasa alcalina, ggt, albumina,
proteinas totales, ldh, amilasa, lipasa, pcr, vsg, procalcitonina, troponina, ck, ckmb, dimero d, inr, tp, ttp,
fibrinogeno, ferritina, hierro, transferrina, acido folico, tsh, t4, t3, cortisol, hba1c, colesterol, hdl, ldl,
trigliceridos, psa, cea, afp, ph, pco2, po2, hco3, lactato, saturacion, vcm, hcm, rdw
""")

VITALS = _terms("""
ta, tension arterial, presion arterial, pa, fc, frecuencia cardiaca, fr, frecuencia respiratoria, temperatura, temp,
sato2, spo2, saturacion de oxigeno, peso, talla, imc, glasgow, eva, diuresis
""")

DRUGS = _terms("""
omeprazol, metformina, losartan, enalapril, amlodipino, atorvastatina, simvastatina, acetaminofen, paracetamol,
ibuprofeno, diclofenaco, naproxeno, dipirona, tramadol, morfina, fentanilo, amoxicilina, ampicilina, ceftriaxona,
cefazolina, meropenem, vancomicina, ciprofloxacina, levofloxacina, azitromicina, claritromicina, clindamicina,
metronidazol, insulina, levotiroxina, warfarina, heparina, enoxaparina, rivaroxaban, apixaban, clopidogrel, aspirina,
furosemida, espironolactona, hidroclorotiazida, prednisona, dexametasona, hidrocortisona, salbutamol, budesonida,
ondansetron, metoclopramida, ranitidina, sulfato, ferroso, oxaliplatino, capecitabina, fluorouracilo, carboplatino,
cisplatino, paclitaxel
""")

ROUTES = _terms("""
vo, iv, im, sc, sl, rectal, topica, inhalada, oral
""")

PROCEDURES = _terms("""
colonoscopia, endoscopia, gastroscopia, biopsia, tac, tc, resonancia, ecografia, ecocardiograma, radiografia, rx,
electrocardiograma, ekg, ecg, espirometria, puncion, laparoscopia, laparotomia, colecistectomia, apendicectomia,
hemicolectomia, colectomia, gastrectomia, toracotomia, cateterismo, angiografia, pet, gammagrafia, mamografia,
citologia, hemocultivo, urocultivo, cultivo, antibiograma
""")

DIAGNOSES = _terms("""
anemia, diabetes, hipertension, epoc, asma, neumonia, sepsis, cancer, carcinoma, adenocarcinoma, linfoma, leucemia,
metastasis, cirrosis, hepatitis, pancreatitis, colecistitis, apendicitis, diverticulitis, colitis, gastritis, ulcera,
infarto, angina, arritmia, fibrilacion, insuficiencia, trombosis, embolia, acv, evc, convulsion, epilepsia, migrana,
artritis, artrosis, osteoporosis, fractura, lesion, polipo, nodulo, masa, quiste, tumor, estenosis, obstruccion,
hemorragia, sangrado, melenas, hematoquecia, ferropenica, microcitica, hipocromica, adenomatoso
""")

MONTHS = _terms("""
enero, febrero, marzo, abril, mayo, junio, julio, agosto, septiembre, setiembre, octubre, noviembre, diciembre
""")

WEEKDAYS = _terms("""
lunes, martes, miercoles, jueves, viernes, sabado, domingo
""")

FUNCTION_WORDS = _terms("""
el, la, los, las, un, una, unos, unas, de, del, al, y, o, en, con, sin, por, para, que, se, su, sus, paciente,
usuario, senor, senora, servicio, consulta, control, urgencias, hospitalizacion, informe, reporte, resultado,
resultados, estudio, estudios, examen, examenes, historia, clinica, nota, evolucion, ingreso, egreso, alta, motivo,
antecedentes, revision, sistemas, analisis, plan, conclusion, conclusiones, impresion, hallazgos, tratamiento,
medicamentos, laboratorio, laboratorios, imagen, imagenes, patologia, muestra, fecha, edad, sexo, masculino, femenino,
hombre, mujer, anos, dia, dias, hoy, ayer, actualmente, refiere, presenta, normal, anormal, positivo, negativo,
diagnostico, diagnosticos, estado, general, actual, previo, valor, valores, referencia, unidad, unidades, total,
totales
""")

SECTORS = _table("""
sector salud: medico, medica, enfermero, enfermera, odontologo, fisioterapeuta, psicologo, auxiliar de enfermeria, bacteriologa
sector educacion: docente, profesor, profesora, maestro, maestra, rector
sector servicios profesionales: abogado, abogada, contador, contadora, arquitecto, notario
sector tecnico: ingeniero, ingeniera, tecnico, mecanico, electricista, soldador, programador
sector transporte: piloto, conductor, taxista, camionero
sector agropecuario: agricultor, campesino, ganadero
sector extractivo: minero
sector construccion: obrero, albanil, constructor
sector comercio: comerciante, vendedor, tendero, cajero
sector seguridad: militar, policia, soldado, vigilante, bombero
sector servicios: peluquero, cocinero, mesero
labores del hogar: ama de casa, hogar
estudiante: estudiante
persona jubilada: jubilado, pensionado
sin ocupacion registrada: desempleado
sector deportivo: futbolista, deportista
sector religioso: sacerdote
sector artistico: musico, actor, actriz
sector comunicaciones: periodista, locutor
""")

REGIONS = _table("""
region andina (Colombia): bogota, medellin, bucaramanga, pereira, manizales, armenia, ibague, neiva, cucuta, pasto, tunja
region pacifica (Colombia): cali, popayan, candelaria, palmira, buenaventura
region caribe (Colombia): barranquilla, cartagena, santa marta, monteria
region orinoquia (Colombia): villavicencio
region amazonica (Colombia): leticia
Espana: madrid, barcelona, valencia, sevilla, zaragoza, bilbao, malaga, murcia
Mexico: ciudad de mexico, guadalajara, monterrey, puebla
Peru: lima, arequipa
Ecuador: quito, guayaquil
Argentina: buenos aires
Uruguay: montevideo
Venezuela: caracas
Panama: panama
Bolivia: la paz
Paraguay: asuncion
Estados Unidos: miami, nueva york
""")

CLINICAL = frozenset((*ANATOMY, *LATERALITY, *ANALYTES, *DRUGS, *PROCEDURES, *DIAGNOSES, *VITALS, *CERTAINTY, *ROUTES))
NOT_NAMES = CLINICAL | frozenset((*MONTHS, *WEEKDAYS, *FUNCTION_WORDS, *NEGATIONS, *INSURERS, *SECTORS, *REGIONS, *DEPARTMENTS))


def longest_first(terms) -> list[str]:
    """In an alternation the first that fits wins, so longer terms go first."""
    return sorted(terms, key=lambda t: (-len(t), t))


def literal(term: str) -> str:
    return re.escape(term).replace(r"\ ", " ")


def alternation(terms) -> str:
    """A pattern for any of the terms. Those that begin alike stand together, so that most are
    passed over at once."""
    by_first: dict[str, list[str]] = {}
    for t in longest_first(terms):
        by_first.setdefault(t[0], []).append(literal(t[1:]))
    return "|".join(literal(c) + "(?:" + "|".join(rest) + ")" for c, rest in sorted(by_first.items()))
