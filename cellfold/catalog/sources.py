"""The catalog's fixed values: five published population grids."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Limits and texts that several sources share.
PLAUSIBLE_TOTAL = (1e8, 2e10)
FLOAT32_MAX = 3.4028234663852886e38
CC_BY = "Creative Commons Attribution 4.0 International (CC BY 4.0)"
DEGREE_120 = (1 / 120, 1 / 120)


@dataclass(frozen=True)
class Source:
    """A published grid. ``delivery`` is geotiff, zip, cube or manual; {year} is filled in."""

    source_id: str
    release: str
    title: str
    publisher: str
    years: tuple[int, ...]
    delivery: str
    landing_page: str
    url: str
    doi: str | None
    license: str
    citation: str
    crs: str
    width: int
    height: int
    cell: tuple[float, float]
    bounds: tuple[float, float, float, float]
    nodata: float | None
    filename: str
    member: str | None = None
    acquisition: str = "automatic"
    meaning: str = "residential"
    units: str = "population count per cell"
    max_bytes: int = 10_000_000_000
    exact_bytes: int | None = None
    checksum: str | None = None
    notes: tuple[str, ...] = ()
    by_year: dict[int, dict] = field(default_factory=dict)

    def value(self, name: str, year: int):
        """A field's value for a year."""
        return self.by_year.get(year, {}).get(name, getattr(self, name))

    @property
    def resolution(self) -> str:
        return DELIVERED[self.source_id][0]

    @property
    def format(self) -> str:
        return DELIVERED[self.source_id][1]

    @property
    def download_size(self) -> str:
        return DELIVERED[self.source_id][2]


# Resolution, format and size of the download of each source, as told to users.
DELIVERED = {
    "worldpop-global-1km": ("30 arc-seconds (about 1 km at the equator)", "single-band GeoTIFF", "roughly 0.8-1.2 GB for one year"),
    "ghsl-r2023a-mollweide-1km": ("1,000 metres on the World Mollweide equal-area grid", "ZIP archive containing a single-band GeoTIFF", "roughly 300 MB for one epoch (the 2020 archive is about 307 MB)"),
    "gpwv4-r11-count": ("30 arc-seconds (about 1 km at the equator)", "Earthdata-authenticated ZIP archive containing a single-band GeoTIFF", "roughly 405 MB for one 30 arc-second year"),
    "chambers-hybrid": ("0.25 degrees", "derived single-band GeoTIFF from one cached NetCDF-4 source", "4,122,344,510 bytes once for the shared source; each requested year is derived locally"),
    "landscan-global": ("30 arc-seconds (about 1 km at the equator)", "manually acquired single-band GeoTIFF", "release-dependent manual download from the ORNL portal"),
}


# Fixed values follow: identifiers, years, addresses, grids and licences as published.
SOURCES = {
    s.source_id: s
    for s in (
        Source(
            source_id="worldpop-global-1km",
            release="Global 2000-2020 1 km mosaics",
            title="Unconstrained global mosaics 2000-2020 (1 km resolution)",
            publisher="WorldPop and CIESIN",
            years=tuple(range(2000, 2021)),
            delivery="geotiff",
            landing_page="https://hub.worldpop.org/geodata/listing?id=64",
            url="https://data.worldpop.org/GIS/Population/Global_2000_2020/{year}/0_Mosaicked/ppp_{year}_1km_Aggregated.tif",
            doi="10.5258/SOTON/WP00647",
            license=CC_BY,
            citation="WorldPop and Center for International Earth Science Information Network (2018). Global High Resolution Population Denominators Project. https://doi.org/10.5258/SOTON/WP00647",
            crs="EPSG:4326",
            width=43200,
            height=18720,
            cell=DEGREE_120,
            bounds=(-180.001249265, -71.99208284398998, 179.99874929500004, 84.00791653201003),
            nodata=-FLOAT32_MAX,
            filename="ppp_{year}_1km_Aggregated.tif",
            max_bytes=1_500_000_000,
            notes=("Modelled annual estimates, not local counts of each year.",),
            by_year={2000: {"nodata": FLOAT32_MAX}, 2020: {"bounds": (-180.001249265, -72.00041617728999, 179.99874929500004, 83.99958319871001)}},
        ),
        Source(
            source_id="ghsl-r2023a-mollweide-1km",
            release="R2023A V1.0",
            title="GHS-POP R2023A - GHS population grid multitemporal (1975-2030)",
            publisher="European Commission, Joint Research Centre (JRC)",
            years=tuple(range(1975, 2021, 5)),
            delivery="zip",
            landing_page="https://data.jrc.ec.europa.eu/dataset/2ff68a52-5b5b-4a22-8f40-c41da8332cfe",
            url="https://jeodpp.jrc.ec.europa.eu/ftp/jrc-opendata/GHSL/GHS_POP_GLOBE_R2023A/GHS_POP_E{year}_GLOBE_R2023A_54009_1000/V1-0/GHS_POP_E{year}_GLOBE_R2023A_54009_1000_V1_0.zip",
            doi="10.2905/2FF68A52-5B5B-4A22-8F40-C41DA8332CFE",
            license="European Commission reuse notice: reuse is authorised provided the source is acknowledged; it does not apply to third-party intellectual property rights.",
            citation="Schiavina, M., Freire, S., and MacManus, K. (2023). GHS-POP R2023A - GHS population grid multitemporal (1975-2030). European Commission, Joint Research Centre (JRC). https://doi.org/10.2905/2FF68A52-5B5B-4A22-8F40-C41DA8332CFE",
            crs="ESRI:54009",
            width=36082,
            height=18000,
            cell=(1000.0, 1000.0),
            bounds=(-18041000.0, -9000000.0, 18041000.0, 9000000.0),
            nodata=-200.0,
            filename="GHS_POP_E{year}_GLOBE_R2023A_54009_1000_V1_0.tif",
            member="GHS_POP_E{year}_GLOBE_R2023A_54009_1000_V1_0.tif",
            max_bytes=750_000_000,
            notes=("Census totals spread by built-up area: not independent of hazards modelled from it.",),
        ),
        Source(
            source_id="gpwv4-r11-count",
            release="Revision 11 (v4.11)",
            title="Gridded Population of the World, Version 4 (GPWv4): Population Count, Revision 11",
            publisher="CIESIN, Columbia University and NASA SEDAC",
            years=(2000, 2005, 2010, 2015, 2020),
            delivery="zip",
            landing_page="https://sedac.ciesin.columbia.edu/data/set/gpw-v4-population-count-rev11",
            url="https://data.earthdata.nasa.gov/nasa-earth/human-dimensions/sedac-root/downloads/data/gpw-v4/gpw-v4-population-count-rev11/gpw-v4-population-count-rev11_{year}_30_sec_tif.zip",
            doi="10.7927/H4JW8BX5",
            license=CC_BY,
            citation="Center for International Earth Science Information Network - CIESIN - Columbia University. (2018). Gridded Population of the World, Version 4 (GPWv4): Population Count, Revision 11 (Version 4.11) [Data set]. Palisades, NY: NASA Socioeconomic Data and Applications Center (SEDAC). https://doi.org/10.7927/H4JW8BX5",
            crs="EPSG:4326",
            width=43200,
            height=21600,
            cell=DEGREE_120,
            bounds=(-180.0, -90.0, 180.0, 90.0),
            nodata=-FLOAT32_MAX,
            filename="gpw_v4_population_count_rev11_{year}_30_sec.tif",
            member="gpw_v4_population_count_rev11_{year}_30_sec.tif",
            acquisition="earthdata",
            max_bytes=600_000_000,
            notes=("Counts are spread evenly from census units of very different sizes.",),
        ),
        Source(
            source_id="chambers-hybrid",
            release="Zenodo record 6011021",
            title="Hybrid gridded demographic data for the world, 1950-2020 0.25 degree resolution",
            publisher="Jonathan Chambers",
            years=tuple(range(1950, 2021)),
            delivery="cube",
            landing_page="https://zenodo.org/records/6011021",
            url="https://zenodo.org/api/records/6011021/files/demographics_hybrid_1950_2020_15_min.nc/content",
            doi="10.5281/zenodo.6011021",
            license=CC_BY,
            citation="Chambers, J. (2022). Hybrid gridded demographic data for the world, 1950-2020 0.25 degree resolution. Zenodo. https://doi.org/10.5281/zenodo.6011021",
            crs="EPSG:4326",
            width=1440,
            height=720,
            cell=(0.25, 0.25),
            bounds=(-180.0, -90.0, 180.0, 90.0),
            nodata=math.nan,
            filename="chambers-hybrid-{year}.tif",
            max_bytes=4_122_344_510,
            exact_bytes=4_122_344_510,
            checksum="md5:b0a9c1354435f104743b9a8165df457d",
            notes=("Two inputs meet in 2000; don't compare across it without care.",),
        ),
        Source(
            source_id="landscan-global",
            release="annual release selected by year",
            title="LandScan Global ambient population",
            publisher="Oak Ridge National Laboratory",
            years=tuple(range(2000, 2025)),
            delivery="manual",
            landing_page="https://landscan.ornl.gov/",
            url="https://landscan.ornl.gov/",
            doi=None,
            license="ORNL LandScan End User License Agreement; redistribution not granted",
            citation="Oak Ridge National Laboratory. ({year}). LandScan Global {year}. Oak Ridge National Laboratory.",
            crs="EPSG:4326",
            width=43200,
            height=21600,
            cell=DEGREE_120,
            bounds=(-180.0, -89.99999999280098, 179.99999998559997, 89.999999999999),
            nodata=None,
            filename="landscan-global-{year}.tif",
            acquisition="manual",
            meaning="ambient",
            units="ambient population count per cell",
            notes=("Average presence over 24 hours, not residents and not the presence at an event.",),
            by_year={
                2024: {
                    "doi": "10.48690/1532445",
                    "citation": "Lebakula, V., Gonzales, J., Stipek, C., Tsybina, E., Zimmer, A., Nukavarapu, N., Byeonghwa, J., Reynolds, B., Kaufman, J., Fan, J., Martin, A., Buck, W., Basford, S., Faxon, A., Meade, S., & Urban, M. (2024). LandScan 2024 [Dataset]. Oak Ridge National Laboratory. https://doi.org/10.48690/1532445",
                }
            },
        ),
    )
}


@dataclass(frozen=True)
class Selection:
    """A source and a year, with what is specific to the year."""

    selection: str
    source_id: str
    release: str
    year: int
    title: str
    publisher: str
    acquisition: str
    landing_page: str
    official_url: str
    doi: str | None
    license: str
    citation: str
    units: str
    population_meaning: str
    crs: str
    resolution: str
    format: str
    download_size: str
    expected_filename: str
    notes: tuple[str, ...]

    @classmethod
    def of(cls, s: Source, year: int) -> Selection:
        return cls(f"{s.source_id}:{year}", s.source_id, s.release, year, s.title, s.publisher, s.acquisition, s.landing_page, s.url.format(year=year), s.value("doi", year), s.license, s.value("citation", year).format(year=year), s.units, s.meaning, s.crs, s.resolution, s.format, s.download_size, s.filename.format(year=year), s.notes)


def catalog_table(spark: SparkSession) -> DataFrame:
    """The sources as a table, in the catalog's order."""
    rows = [(s.source_id, s.release, s.title, s.publisher, s.years[0], s.years[-1], len(s.years), s.acquisition, s.delivery, s.crs, s.width, s.height, s.meaning) for s in SOURCES.values()]
    return spark.createDataFrame(rows, "source_id string, release string, title string, publisher string, first_year int, last_year int, n_years int, acquisition string, delivery string, crs string, width int, height int, meaning string")


