"""Declared schemas of the registry tables."""

DOCUMENT = "struct<kind:string,series:string,number:string,raw:string>"
DECISION = "id string, number int, date date, title string, regime string, kind string, status string, measures array<string>, file string, amendedBy array<string>, instruments array<string>, theme string, subjectCount int, notice string, ord int"
SUBJECT = f"id string, decisionId string, listNumber string, type string, name string, aliases array<string>, birthDate date, citizenship array<string>, idnp string, documents array<{DOCUMENT}>, regime string, active boolean, moldova boolean, listing struct<foreign:date,md:date>, page int, ord int"
DETAIL_STRUCT = "struct<function:string,birthPlace:string,gender:string,reason:string,notes:string,identifiersText:string,listingRaw:string,page:int>"
DETAIL = "id string, function string, birthPlace string, gender string, reason string, notes string, identifiersText string, listingRaw string, page int"
WORD = "file string, page int, page_width double, page_height double, ord int, x0 double, y0 double, x1 double, y1 double, text string"
