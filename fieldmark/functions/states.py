"""State dictionaries of the countries, for membership tests and display names.

Fixed values; the keys are the codes or names that the registers hold.
"""

US = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "DC": "District of Columbia", "AS": "American Samoa", "GU": "Guam", "MP": "Northern Mariana Islands", "PR": "Puerto Rico", "VI": "U.S. Virgin Islands",
}
GERMANY = {
    "BW": "Baden-Württemberg", "BY": "Bayern", "BE": "Berlin", "BB": "Brandenburg", "HB": "Bremen", "HH": "Hamburg", "HE": "Hessen", "MV": "Mecklenburg-Vorpommern", "NI": "Niedersachsen",
    "NW": "Nordrhein-Westfalen", "RP": "Rheinland-Pfalz", "SL": "Saarland", "SN": "Sachsen", "ST": "Sachsen-Anhalt", "SH": "Schleswig-Holstein", "TH": "Thüringen", "DE_UNKNOWN": "Deutschland (Unspecified)",
}
SPAIN = {
    "Andalucía": "Andalucía", "Aragón": "Aragón", "Asturias": "Asturias", "Cantabria": "Cantabria", "Canarias": "Canarias", "Castilla-La Mancha": "Castilla-La Mancha",
    "Castilla y León": "Castilla y León", "Cataluña": "Cataluña", "Ceuta": "Ceuta", "Comunidad de Madrid": "Comunidad de Madrid", "Comunidad Valenciana": "Comunidad Valenciana",
    "Extremadura": "Extremadura", "Galicia": "Galicia", "Illes Balears": "Illes Balears", "La Coruña": "La Coruña", "A Coruña": "A Coruña", "La Rioja": "La Rioja", "Navarra": "Navarra",
    "País Vasco": "País Vasco", "Región de Murcia": "Región de Murcia", "Álava": "Álava", "Albacete": "Albacete", "Alicante": "Alicante", "Almería": "Almería", "Ávila": "Ávila",
    "Badajoz": "Badajoz", "Barcelona": "Barcelona", "Burgos": "Burgos", "Cáceres": "Cáceres", "Cádiz": "Cádiz", "Castellón": "Castellón", "Ciudad Real": "Ciudad Real", "Córdoba": "Córdoba",
    "Cuenca": "Cuenca", "Girona": "Girona", "Granada": "Granada", "Guadalajara": "Guadalajara", "Guipúzcoa": "Guipúzcoa", "Huelva": "Huelva", "Huesca": "Huesca", "Jaén": "Jaén",
    "León": "León", "Lleida": "Lleida", "Lugo": "Lugo", "Madrid": "Madrid", "Málaga": "Málaga", "Murcia": "Murcia", "Ourense": "Ourense", "Palencia": "Palencia", "Palma": "Palma",
    "Palmas (Las)": "Palmas (Las)", "Pontevedra": "Pontevedra", "Salamanca": "Salamanca", "Santa Cruz de Tenerife": "Santa Cruz de Tenerife", "Segovia": "Segovia", "Sevilla": "Sevilla",
    "Soria": "Soria", "Tarragona": "Tarragona", "Teruel": "Teruel", "Toledo": "Toledo", "Valencia": "Valencia", "Valladolid": "Valladolid", "Vizcaya": "Vizcaya", "Zamora": "Zamora",
    "Zaragoza": "Zaragoza", "Catalunya": "Cataluña", "Euskadi": "País Vasco", "Lérida": "Lleida", "ES_UNKNOWN": "España (Unspecified)",
}
FRANCE = {
    "01": "Ain", "02": "Aisne", "03": "Allier", "04": "Alpes-de-Haute-Provence", "05": "Hautes-Alpes", "06": "Alpes-Maritimes", "07": "Ardèche", "08": "Ardennes", "09": "Ariège",
    "10": "Aube", "11": "Aude", "12": "Aveyron", "13": "Bouches-du-Rhône", "14": "Calvados", "15": "Cantal", "16": "Charente", "17": "Charente-Maritime", "18": "Cher", "19": "Corrèze",
    "21": "Côte-d'Or", "22": "Côtes-d'Armor", "23": "Creuse", "24": "Dordogne", "25": "Doubs", "26": "Drôme", "27": "Eure", "28": "Eure-et-Loir", "29": "Finistère", "30": "Gard",
    "31": "Haute-Garonne", "32": "Gers", "33": "Gironde", "34": "Hérault", "35": "Ille-et-Vilaine", "36": "Indre", "37": "Indre-et-Loire", "38": "Isère", "39": "Jura", "40": "Landes",
    "41": "Loir-et-Cher", "42": "Loire", "43": "Haute-Loire", "44": "Loire-Atlantique", "45": "Loiret", "46": "Lot", "47": "Lot-et-Garonne", "48": "Lozère", "49": "Maine-et-Loire",
    "50": "Manche", "51": "Marne", "52": "Haute-Marne", "53": "Mayenne", "54": "Meurthe-et-Moselle", "55": "Meuse", "56": "Morbihan", "57": "Moselle", "58": "Nièvre", "59": "Nord",
    "60": "Oise", "61": "Orne", "62": "Pas-de-Calais", "63": "Puy-de-Dôme", "64": "Pyrénées-Atlantiques", "65": "Hautes-Pyrénées", "66": "Pyrénées-Orientales", "67": "Bas-Rhin",
    "68": "Haut-Rhin", "69": "Rhône", "70": "Haute-Saône", "71": "Saône-et-Loire", "72": "Sarthe", "73": "Savoie", "74": "Haute-Savoie", "75": "Paris", "76": "Seine-Maritime",
    "77": "Seine-et-Marne", "78": "Yvelines", "79": "Deux-Sèvres", "80": "Somme", "81": "Tarn", "82": "Tarn-et-Garonne", "83": "Var", "84": "Vaucluse", "85": "Vendée", "86": "Vienne",
    "87": "Haute-Vienne", "88": "Vosges", "89": "Yonne", "90": "Territoire de Belfort", "91": "Essonne", "92": "Hauts-de-Seine", "93": "Seine-Saint-Denis", "94": "Val-de-Marne",
    "95": "Val-d'Oise", "971": "Guadeloupe", "972": "Martinique", "973": "Guyane", "974": "La Réunion", "976": "Mayotte", "FR_UNKNOWN": "France (Unspecified)",
}
CANADA = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland & Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut",
    "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
MEXICO = {
    "AGUASCALIENTES": "Aguascalientes", "BAJA CALIFORNIA": "Baja California", "BAJA CALIFORNIA SUR": "Baja California Sur", "CAMPECHE": "Campeche", "CHIAPAS": "Chiapas",
    "CHIHUAHUA": "Chihuahua", "CIUDAD DE MÉXICO": "Ciudad de México", "COAHUILA DE ZARAGOZA": "Coahuila de Zaragoza", "COLIMA": "Colima", "DURANGO": "Durango", "GUANAJUATO": "Guanajuato",
    "GUERRERO": "Guerrero", "HIDALGO": "Hidalgo", "JALISCO": "Jalisco", "MICHOACÁN DE OCAMPO": "Michoacán de Ocampo", "MORELOS": "Morelos", "MÉXICO": "México", "NAYARIT": "Nayarit",
    "NUEVO LEÓN": "Nuevo León", "OAXACA": "Oaxaca", "PUEBLA": "Puebla", "QUERÉTARO": "Querétaro", "QUINTANA ROO": "Quintana Roo", "SAN LUIS POTOSÍ": "San Luis Potosí", "SINALOA": "Sinaloa",
    "SONORA": "Sonora", "TABASCO": "Tabasco", "TAMAULIPAS": "Tamaulipas", "TLAXCALA": "Tlaxcala", "VERACRUZ DE IGNACIO DE LA LLAVE": "Veracruz de Ignacio de la Llave", "YUCATÁN": "Yucatán",
    "ZACATECAS": "Zacatecas",
}
REGIONS = {"US": list(US), "DE": list(GERMANY), "ES": list(SPAIN), "FR": list(FRANCE), "CA": list(CANADA), "MX": list(MEXICO)}
#: Countries whose rows carry a tag as well.
TAGGED = {"FR", "CA", "MX", "DK", "NZ"}
