"""Countries, their join-key definitions, labels and translations."""

from __future__ import annotations

DEFAULT_COUNTRY = "france"

# Metric EPSG code and WGS84 bounds (min lon, min lat, max lon, max lat).
COUNTRIES = {
    "france": (2154, (-5.5, 41.0, 10.0, 51.5)),
    "uk": (27700, (-8.5, 49.5, 2.0, 61.0)),
    "germany": (25832, (5.9, 47.3, 15.0, 55.1)),
    "italy": (25832, (6.6, 36.6, 18.5, 47.1)),
    "spain": (2062, (-9.3, 35.9, 4.3, 43.8)),
    "usa": (4326, (-125.0, 24.0, -66.0, 50.0)),
    "europe": (3035, (-25.0, 34.0, 45.0, 72.0)),
}

# Fixed value: metres are needed for areas where the country's own code is in degrees.
AREA_CRS = {"usa": 5070}

# Fixed values: (label, name substrings, value format) by country, in order of precedence.
KEY_DEFINITIONS = {
    "france": [
        ("Code INSEE commune", ["code_insee", "insee_com", "codgeo", "insee", "commune"], r"^\d{5}$"),
        ("Code postal", ["code_postal", "codepostal", "cp", "postal"], r"^\d{5}$"),
        ("Code département", ["code_dep", "num_dep", "departement", "département", "dep"], r"^(\d{2,3}|2[AB])$"),
        ("Code région", ["code_reg", "num_reg", "region", "reg"], r"^\d{2}$"),
        ("Code IRIS", ["code_iris", "iris"], r"^\d{9}$"),
        ("Code EPCI", ["code_epci", "epci", "siren_epci"], r"^\d{9}$"),
    ],
    "uk": [
        ("Postcode", ["postcode", "post_code", "pcd"], r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$"),
        ("ONS area code", ["ons_code", "area_code", "geo_code"], r"^[EWS]\d{8}$"),
        ("Local Authority code", ["lad_code", "lad21cd", "local_authority"], None),
        ("LSOA code", ["lsoa_code", "lsoa11cd", "lsoa"], None),
        ("MSOA code", ["msoa_code", "msoa11cd", "msoa"], None),
    ],
    "germany": [
        ("Postleitzahl (PLZ)", ["plz", "postleitzahl", "postcode", "post"], r"^\d{5}$"),
        ("Gemeindeschlüssel", ["ags", "gemeinde", "gemeindeschluessel"], r"^\d{8}$"),
        ("Kreisschlüssel", ["kreis", "landkreis", "krs"], r"^\d{5}$"),
        ("Bundesland code", ["bundesland", "land_code", "bland"], r"^\d{2}$"),
        ("NUTS code", ["nuts", "nuts_code", "nuts3"], r"^DE\w+$"),
    ],
    "italy": [
        ("CAP (codice postale)", ["cap", "codice_postale", "postal"], r"^\d{5}$"),
        ("Codice ISTAT comune", ["istat", "cod_istat", "pro_com"], r"^\d{6}$"),
        ("Codice provincia", ["cod_prov", "provincia", "sigla_prov"], r"^\d{3}$"),
        ("Codice regione", ["cod_reg", "regione"], r"^\d{2}$"),
        ("NUTS code", ["nuts", "nuts_code"], r"^IT\w+$"),
    ],
    "spain": [
        ("Código postal", ["cod_postal", "codigo_postal", "postal", "cp"], r"^\d{5}$"),
        ("Código INE municipio", ["cod_ine", "codigo_ine", "cusec"], r"^\d{5}$"),
        ("Código provincia", ["cod_prov", "provincia"], r"^\d{2}$"),
        ("Código comunidad", ["cod_ccaa", "comunidad", "ccaa"], r"^\d{2}$"),
        ("NUTS code", ["nuts", "nuts_code"], r"^ES\w+$"),
    ],
    "usa": [
        ("ZIP code", ["zip", "zip_code", "zipcode", "postal"], r"^\d{5}(-\d{4})?$"),
        ("FIPS state code", ["fips", "state_fips", "statefp"], r"^\d{2}$"),
        ("FIPS county code", ["county_fips", "countyfp", "fips_county"], r"^\d{5}$"),
        ("Census tract", ["tract", "census_tract", "tractce"], None),
        ("State abbreviation", ["state_abbr", "state_code", "stusps"], r"^[A-Z]{2}$"),
    ],
    "europe": [
        ("NUTS 0 (country)", ["nuts0", "country_code", "cntr_code"], r"^[A-Z]{2}$"),
        ("NUTS 1", ["nuts1", "nuts_1"], r"^[A-Z]{2}\d$"),
        ("NUTS 2", ["nuts2", "nuts_2"], r"^[A-Z]{2}\d{2}$"),
        ("NUTS 3", ["nuts3", "nuts_3"], r"^[A-Z]{2}\d{3}$"),
        ("LAU code", ["lau", "lau_code", "lau_id"], None),
    ],
}

# How a geometry was found, as reported.
LABEL_NATIVE = "Présence Géométrie"
LABEL_PAIR = "Présence géométrie séparée (x,y)"
LABEL_ENDPOINTS = "Présence géométrie multiples (x1,y1), (x2,y2)"
LABEL_ADDRESS = "Géocodage de l'adresse"
LABEL_KEYS = "Jointure spatiale à l'aide de clés géographiques"
LABEL_NONE = "Aucune géométrie"
LABEL_GEOSPATIAL = "Données géographiques"

# Words in a table's name that speak against and for its being the data table.
NOTE_WORDS = ["readme", "lisez", "info", "indic", "description", "metadata", "note", "about", "legend", "source"]
DATA_WORDS = ["data", "donnee", "donnée", "tableau", "main", "result", "mesure", "values", "export"]

# File extensions by family.
GEO_EXTENSIONS = [".shp", ".gpkg", ".geojson", ".json"]
TABLE_EXTENSIONS = [".csv", ".txt", ".xlsx"]
SUPPORTED_EXTENSIONS = [".csv", ".xlsx", ".geojson", ".json", ".shp", ".gpkg", ".txt"]

# Geometry column names in order of preference.
GEOMETRY_NAMES = ["geom", "geometry", "wkb_geometry", "shape", "the_geom"]

# Leading columns of a report table, in order.
REPORT_COLUMNS = [
    "filepath",
    "success",
    "Dossier",
    "Nom du fichier",
    "Type de fichier",
    "Taille (Ko)",
    "Nb lignes",
    "Nb colonnes",
    "Temps de traitement (s)",
    "Géotransformation",
    "CRS",
    "Types de géométrie",
    "Emprise estimée (km2)",
    "Couverture territoriale hexagonale (%)",
]

# Report texts, French to English.
ENGLISH = {
    "Nom du fichier": "File name",
    "Taille (Ko)": "Size (KB)",
    "Date de création du fichier (Y-M-D)": "File creation date (Y-M-D)",
    "Type de fichier": "File type",
    "Nb lignes": "Nb rows",
    "Nb colonnes": "Nb columns",
    "Colonnes": "Columns",
    "Score de complétude global": "Global completeness score",
    "Clés géographiques": "Geographic keys",
    "Géotransformation": "Geotransformation",
    "Score de complétude des clés géographique": "Geographic key completeness score",
    "Score de complétude géographique": "Geographic completeness score",
    "Score de complétude moyen": "Mean completeness score",
    "Score de complétude std": "Completeness std score",
    "Score de complétude moyen (%)": "Mean completeness score (%)",
    "Score de complétude std (%)": "Completeness std score (%)",
    "CRS": "CRS",
    "Types de géométrie": "Geometry types",
    "Emprise estimée (km2)": "Estimated extent (km2)",
    "Densité (obj/km2)": "Density (obj/km2)",
    "Taux de remplissage géométrique (%)": "Geometric fill rate (%)",
    "Complexite moyenne": "Average complexity",
    "Geometries dupliquees (%)": "Duplicate geometries (%)",
    "Couverture territoriale (%)": "Territorial coverage (%)",
    "Clé identifiée": "Identified key",
    "Aire de référence": "Reference area",
    "Présence géométrie séparée (x,y)": "Separate geometry presence (x, y)",
    "Présence géométrie multiples (x1,y1), (x2,y2)": "Presence of multiple geometries (x1,y1), (x2,y2)",
    "Jointure spatiale à l'aide de clés géographiques": "Spatial join using geographic keys",
    "Présence géométrie": "Presence geometry",
    "Géocodage de l'adresse": "Address geocoding",
    "Aucune géométrie": "No geometry",
    "Granularité": "Granularity",
    "Complexité moyenne des géométries": "Average complexity of geometries",
    "Part des geometries dupliquees (%)": "Percentage of duplicate geometries (%)",
    "Colonne": "Column",
    "Exemple": "Example",
    "Type": "Type",
    "Valeurs manquantes": "Missing values",
    "Présentes (%)": "Presence (%)",
    "Valides (%)": "Valid (%)",
    "Données géographiques": "Geographic data",
}
