"""National registers from raw files to the location table, against rows written by hand."""

import pytest

from fieldmark.functions import provinces
from fieldmark.operators.locations import COLUMNS
from fieldmark.sources import national


def rows(table):
    """Rows in file order, blanks and zero coordinates left out; every row has the table's columns."""
    assert table.columns == [*COLUMNS, "_ord", "country"]
    found = [r.asDict() for r in table.orderBy("_ord").collect()]
    assert all(r["latitude"] is not None and r["longitude"] is not None for r in found)
    return [{k: v for k, v in r.items() if v not in ("", 0.0) and k not in ("_ord", "country")} for r in found]


def flags(names, value="Yes"):
    return dict.fromkeys(names.split(), value)


def test_italy(spark, tmp_path):
    (tmp_path / "it.csv").write_text(
        "﻿APPROVAL NUMBER,NAME,VAT,TOWN/REGION,ASSOCIATED ACTIVITIES,SPECIES\n"
        '40 L, MACELLO SUD ,012,"VIA ROMA 1, BASSIANO (LT)",CP-SH,B|P\n'
        " ,NO NUMBER,1,X,CP,B\n"
        '41,"AL ""NORD""",,CONTRADA ALTA,,-\n'
        '42,C,,"VIA PO, ASTI, NORD (ZZ)",SH,\n'
    )
    common = {"size": "Unknown", "processing_volume_category": "Unknown"}
    got = national.read_locations(spark, national.ITALY, str(tmp_path / "it.csv"))
    assert rows(got) == [
        {"establishment_id": "40 L", "establishment_number": "40 L", "establishment_name": "MACELLO SUD", "duns_number": "012", "street": "VIA ROMA 1", "city": "BASSIANO", "state": "Latina", "county": "Latina", "type": "Meat Processing; Meat Slaughter"} | common,
        {"establishment_id": "41", "establishment_number": "41", "establishment_name": 'AL "NORD"', "street": "CONTRADA ALTA", "type": "Meat Production"} | common,
        {"establishment_id": "42", "establishment_number": "42", "establishment_name": "C", "street": "VIA PO", "city": "ASTI, NORD", "state": "ZZ", "county": "ZZ", "type": "Meat Slaughter"} | common,
    ]
    assert [r._ord for r in got.orderBy("_ord").collect()] == [0, 2, 3] and {r.country for r in got.collect()} == {"it"}
    (tmp_path / "bad.csv").write_text("APPROVAL NUMBER,VAT\n1,2\n")
    with pytest.raises(ValueError, match="Italian register lacks the columns"):
        national.read_locations(spark, national.ITALY, str(tmp_path / "bad.csv"))
    assert provinces.ITALY["RC"] == "Reggio di Calabria" and len(set(provinces.ITALY)) == len(provinces.ITALY)


def test_canada(spark, tmp_path):
    (tmp_path / "fed.csv").write_bytes(
        "Establishment number,Name of the operator,Telephone Number,Function Codes,Geocodio Address Line 1,Geocodio City,Geocodio State,Geocodio Postal Code,Geocodio Latitude,Geocodio Longitude\n"
        "12,Abattoir Été Also Doing Business As Name: Été 2, 555-1 ,1d,1 Rue Été,Laval,QC,H7A,45.5,-73.7\n"
        "13,Plain Foods,,6fx,,Ajax,ON,,45.5,west\n"
        "14,No Codes,,,,,,,,\n".encode("latin-1")
    )
    (tmp_path / "on.csv").write_text(
        'Plant Number_No. de l\'usine,Plant Name_ Nom de l\'usine,Address_Adresse,City_Ville,Province,Postal Code_Code postal,Telephone_Téléphone,FP_ETVA avec abattoir,FSMP_ETVA,"Deer, Elk_Cerfs, Élans",Beef_Boeuf,Latitude,Longitude\n'
        "7,Élan Meats,2 Way,Guelph,Ontario,N1G,555,1,0,1,0,43.5,-80.2\n8,Cuts,,,Ontario,,,,1,0,0,,\n"
    )
    fed, on = national.read_locations(spark, national.FEDERAL_CANADA, str(tmp_path / "fed.csv")), national.read_locations(spark, national.ONTARIO, str(tmp_path / "on.csv"))
    day = {"grant_date": "2025-01-01"}
    assert rows(fed) == [
        {"establishment_id": "CA_FED_12", "establishment_number": "12", "establishment_name": "Abattoir Été", "dbas": "As  Été 2", "phone": "555-1", "type": "Slaughter", "street": "1 Rue Été", "city": "Laval", "state": "QC", "zip": "H7A", "latitude": 45.5, "longitude": -73.7, "market_swine_slaughter": "Yes"} | day,
        {"establishment_id": "CA_FED_13", "establishment_number": "13", "establishment_name": "Plain Foods", "type": "Processing", "city": "Ajax", "state": "ON", "chicken_processing": "Yes", "rabbit_processing": "Yes"} | day,
        {"establishment_id": "CA_FED_14", "establishment_number": "14", "establishment_name": "No Codes", "type": "Unknown"} | day,
    ]
    assert rows(on) == [
        {"establishment_id": "CA_ON_7", "establishment_number": "7", "establishment_name": "Élan Meats", "street": "2 Way", "city": "Guelph", "state": "Ontario", "zip": "N1G", "phone": "555", "type": "Slaughter", "latitude": 43.5, "longitude": -80.2} | flags("deer_reindeer_slaughter elk_slaughter") | day,
        {"establishment_id": "CA_ON_8", "establishment_number": "8", "establishment_name": "Cuts", "state": "Ontario", "type": "Processing"} | day,
    ]
    both = national.combined([fed, on])
    assert [r.establishment_id for r in both.orderBy("_source", "_ord").collect()] == ["CA_FED_12", "CA_FED_13", "CA_FED_14", "CA_ON_7", "CA_ON_8"]


def test_mexico(spark, tmp_path):
    head = "id,nom_estab,raz_social,codigo_act,tipo_vial,nom_vial,numero_ext,letra_ext,numero_int,letra_int,nomb_asent,municipio,entidad,cod_postal,telefono,fecha_alta,latitud,longitud\n"
    (tmp_path / "mx.csv").write_bytes(
        (head + "1,GRANJA PEÑA,PEÑA SA,112511,,,,,,,,,,,,,,\n2,GRANJA PEÑA,PEÑA SA,112512 ,,,,,,,,,,,,,,\n3, TILAPIA ÑU,ÑU SA, 112513 ,CALLE,SOL,4,B,2,,CENTRO,MÉRIDA,YUCATÁN,97000,(999) 1-2 ext,2020-01,20.97,-89.6\n"
         "4,,,114111,,,,,,,,,,,,,95,-89\n5,SERVICIOS,,115210,AVENIDA,MAR,,,,,,LA PAZ,BCS,23000,,2019-07,0,-110.3\n").encode("latin-1")
    )
    whole = rows(national.read_locations(spark, national.MEXICO, str(tmp_path / "mx.csv")))
    want = [
        {"establishment_id": "3", "establishment_number": "3", "establishment_name": "TILAPIA ÑU", "dbas": "ÑU SA", "street": "CALLE SOL 4 B Int. 2", "city": "CENTRO", "county": "MÉRIDA", "state": "YUCATÁN", "zip": "97000", "phone": "(999)1-2", "grant_date": "2020-01", "type": "Aquaculture Farm", "latitude": 20.97, "longitude": -89.6},
        {"establishment_id": "4", "establishment_number": "4", "establishment_name": "Unknown", "street": "Unknown", "city": "Unknown", "county": "Unknown", "state": "Unknown", "type": "Fishing Operation"},
        {"establishment_id": "5", "establishment_number": "5", "establishment_name": "SERVICIOS", "street": "AVENIDA MAR", "city": "LA PAZ", "county": "LA PAZ", "state": "BCS", "zip": "23000", "grant_date": "2019-07", "type": "Farm / Breeder"},
    ]
    assert whole == want
    assert rows(national.read_locations(spark, national.MEXICO_FOCUSED, str(tmp_path / "mx.csv"))) == [want[0], want[2]]


def test_mexican_units(spark, tmp_path):
    head = "ID,Nombre de la Unidad Económica,Razón social,Nombre de clase de la actividad,Tipo de vialidad,Nombre de la vialidad,Localidad,Municipio,Entidad federativa,Código Postal,Número de teléfono,Latitud,Longitud,Descripcion estrato personal ocupado\n"
    (tmp_path / "meat.csv").write_bytes((head + "1,,RASTRO SA,Matanza de ganado y aves,CALLE,SOL,,LEÓN,GTO,37000,477 1,21.1,-101.6,6 a 10 personas\n,SIN ID,,Matanza,,,,,,,,21,-101,\n3,LEJOS,,Matanza,,,,,,,,0,-101,\n4,LAB,,Laboratorios de análisis,,,X,Y,,,,20,-100,\n").encode("latin-1"))
    got = rows(national.read_locations(spark, national.MEXICO_UNITS, str(tmp_path / "meat.csv")))
    assert got == [
        {"establishment_id": "1", "establishment_number": "1", "establishment_name": "RASTRO SA", "dbas": "RASTRO SA", "street": "CALLE SOL", "city": "LEÓN", "state": "GTO", "zip": "37000", "phone": "477 1", "type": "Slaughterhouse", "latitude": 21.1, "longitude": -101.6, "size": "6 a 10 personas"} | flags("beef_cow_slaughter beef_processing meat_slaughter poultry_slaughter"),
        {"establishment_id": "4", "establishment_number": "4", "establishment_name": "LAB", "city": "X", "type": "Laboratory", "latitude": 20.0, "longitude": -100.0},
    ]
    (tmp_path / "aqua.csv").write_bytes("establishment_id,establishment_name,dbas,type,latitude,longitude,size\n9,,PEZ SA,Aquaculture Farm,20,-100,\n10,X,,Y,,,\n".encode("latin-1"))
    aqua = national.read_locations(spark, national.MEXICO_AQUACULTURE, str(tmp_path / "aqua.csv"))
    assert rows(aqua) == [{"establishment_id": "9", "establishment_name": "PEZ SA", "dbas": "PEZ SA", "type": "Aquaculture", "latitude": 20.0, "longitude": -100.0}]


def test_united_kingdom(spark, tmp_path):
    (tmp_path / "uk.csv").write_text(
        "id,name,operator,address,county,classifications,firstImportedAt,latitude,longitude\n"
        '1, Oak ,Oak Ltd,"1 Mill Lane, Leeds, LS1 4AB, United Kingdom",Yorkshire,"CowSlaughterhouse,DairyFarm",2020-05-06T07:08,53.8,x\n'
        '2,Elm,Elm,"Elm Farm, Bath",Avon,OtherMammalSlaughterhouse,,51.4,-2.4\n'
        "3,Ash,,,,,,,\n"
    )
    common = {"size": "Unknown", "slaughter_volume_category": "Unknown", "processing_volume_category": "Unknown"}
    raw = str(tmp_path / "uk.csv")
    got = national.read_locations(spark, national.UNITED_KINGDOM, raw)
    want = [
        {"establishment_id": "1", "establishment_number": "1", "establishment_name": " Oak ", "dbas": "Oak Ltd", "street": "1 Mill Lane", "city": "Leeds", "zip": "LS1 4AB", "state": "Yorkshire", "county": "Yorkshire", "grant_date": "2020-05-06", "type": "Meat Slaughter; Animal Production", "latitude": 53.8} | flags("slaughter meat_slaughter beef_cow_slaughter steer_slaughter heifer_slaughter bull_stag_slaughter dairy_cow_slaughter") | common,
        {"establishment_id": "2", "establishment_number": "2", "establishment_name": "Elm", "street": "Elm Farm", "city": "Bath", "state": "Avon", "county": "Avon", "type": "Meat Slaughter", "latitude": 51.4, "longitude": -2.4, "other_voluntary_livestock_slaughter": "Yes"} | common,
        {"establishment_id": "3", "establishment_number": "3", "establishment_name": "Ash", "type": "Unknown"} | common,
    ]
    assert rows(got) == want
    names = national.read_in_order(spark, [raw]).where("id <> 3")
    typed = national.with_british_types(got, names)
    assert [r["type"] for r in rows(typed)] == ["Dairy Farm", "Other Mammal Slaughterhouse", "Unknown"]


def test_spain(spark, tmp_path):
    (tmp_path / "es.csv").write_text(
        "id,name,operator,address,country,county,classifications,firstImportedAt,latitude,longitude\n"
        '1,Granja,Op,"Calle Sol 1, Lugo, 27001, España",Galicia,Lugo,"GranjaPorcinaIntensiva,Acuicultura",2021-02-03T04,43.0,-7.5\n'
        '2,Mar,Mar,"Finca Alta, Soria",,Soria,GranjaAvícolaIntensiva,,,x\n'
    )
    common = {"size": "Unknown", "slaughter_volume_category": "Unknown", "processing_volume_category": "Unknown"}
    assert rows(national.read_locations(spark, national.SPAIN, str(tmp_path / "es.csv"))) == [
        {"establishment_id": "1", "establishment_number": "1", "establishment_name": "Granja", "dbas": "Op", "street": "Calle Sol 1", "city": "Lugo", "zip": "27001", "state": "Galicia", "county": "Lugo", "grant_date": "2021-02-03", "type": "Animal Production; Aquaculture", "latitude": 43.0, "longitude": -7.5} | common,
        {"establishment_id": "2", "establishment_number": "2", "establishment_name": "Mar", "street": "Finca Alta", "city": "Soria", "state": "Soria", "county": "Soria", "type": "Animal Production"} | common,
    ]


def test_denmark(spark, tmp_path):
    row = "<row><branche>{}</branche><navn1>{}</navn1><adresse1>Vej 1</adresse1><postnr>{}</postnr><By>Aarhus</By><Geo_Lat>{}</Geo_Lat><Geo_Lng>10.2</Geo_Lng></row>"
    kinds = [("Bager", "no", "1", "1"), ("Slagterier", "Kød A/S", "8000", "56.1"), ("Restaurant", "no", "1", "1"), ("Fremstilling af animalske produkter - Æg", "Æg", "0800", "")]
    (tmp_path / "dk.xml").write_text("<document>" + "".join(row.format(*k) for k in kinds) + "</document>")
    assert rows(national.read_denmark(spark, str(tmp_path / "dk.xml"))) == [
        {"establishment_id": "0", "establishment_name": "Kød A/S", "street": "Vej 1", "zip": "8000", "city": "Aarhus", "county": "Denmark", "type": "Meat Processing; Meat Slaughter", "latitude": 56.1, "longitude": 10.2},
        {"establishment_id": "1", "establishment_name": "Æg", "street": "Vej 1", "zip": "800", "city": "Aarhus", "county": "Denmark", "type": "Meat Processing", "longitude": 10.2},
    ]


def test_germany(spark, tmp_path):
    (tmp_path / "de.csv").write_text('BY 1,,Hof," Weg 2 80331 München",SH,x,"B, wL"\n ,DE 2,Lager,Nowhere,,,A\nBY 3,,Zerlegung,10115 Berlin,CP,,wU\n')
    cache = spark.createDataFrame([("Weg 2", "München", "80331", "48.1", "11.5", 0), ("", "Berlin", "10115", "bad", "1", 1)], "street string, city string, zip string, latitude string, longitude string, _ord long")
    got = rows(national.read_germany(spark, str(tmp_path / "de.csv"), cache))
    cattle = "beef_cow steer heifer bull_stag dairy_cow heavy_calf bob_veal formula_fed_veal non_formula_fed_veal rabbit"
    assert got == [
        {"establishment_id": "BY 1", "establishment_name": "Hof", "street": "Weg 2", "zip": "80331", "city": "München", "type": "Meat Processing; Meat Slaughter", "latitude": 48.1, "longitude": 11.5} | flags(" ".join(f"{n}_slaughter" for n in cattle.split()) + " slaughter meat_slaughter beef_processing rabbit_processing"),
        {"establishment_id": "DE 2", "establishment_name": "Lager"},
        {"establishment_id": "BY 3", "establishment_name": "Zerlegung", "zip": "10115", "city": "Berlin", "type": "Meat Processing"} | flags("slaughter_or_processing_only deer_processing elk_processing"),
    ]


def test_france(spark, tmp_path):
    mark = "<Placemark>{}<description>{}</description><Point><coordinates> 2.5,48.5,0 </coordinates></Point></Placemark>"
    (tmp_path / "fr.kml").write_text("<kml><Document><Folder><name>Abattoirs</name>" + mark.format("<name> Un </name>", "") + mark.format("", "&lt;b&gt;Ferme  pédagogique") + "</Folder><Folder><name>Points reçus</name>" + mark.format("<name>Trois</name>", "x") + "</Folder></Document></kml>")
    common = {"size": "Unknown", "slaughter_volume_category": "Unknown", "processing_volume_category": "Unknown", "grant_date": "2024-03-01", "latitude": 48.5, "longitude": 2.5}
    assert rows(national.read_france(spark, str(tmp_path / "fr.kml"))) == [
        {"establishment_id": str(i), "establishment_number": str(i), "establishment_name": n, "type": t} | common for i, n, t in ((1, "Un", "Meat Slaughter"), (2, "Location 2", "Exhibition"), (3, "Trois", "Other"))
    ]


def test_new_zealand(spark, tmp_path):
    (tmp_path / "nz.csv").write_text("MPI ID Number,Operator Business Name,Operator Trading Name,Physical Address,Physical Town/City,Operator Local Authority,Effective Date,Risk Measure Type,Programme Type,Secondary Process,Product/Material\nME1,Kiwi Ltd,Kiwi,1 Rd,Levin,Horowhenua,2020-01-01,RMP,,Slaughter of birds,Poultry\n")
    table = national.read_locations(spark, national.NEW_ZEALAND, str(tmp_path / "nz.csv"))
    assert rows(table) == [{"establishment_id": "ME1", "establishment_name": "Kiwi Ltd", "dbas": "Kiwi", "street": "1 Rd", "city": "Levin", "state": "Horowhenua", "grant_date": "2020-01-01", "type": "RMP", "slaughter": "Yes", "animals_slaughtered_list": "Poultry", "animals_processed_list": "Poultry"}]
    assert table.select(national.new_zealand_address()).first()[0] == "1 Rd, Levin, New Zealand"
