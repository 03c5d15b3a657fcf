"""Fixed values of announced fields: words that results depend on, as plain text.

A line is a label and its names, or a list of words.  A name in brackets counts only with a link sign or a number word after
it; one with an asterisk only where the text around it speaks of a person's documents.
"""

from __future__ import annotations

# Field names by label.
FIELDS = """
IBAN: iban
TELEPHONENUM: phone, phone number, telephone, téléphone, tel, tél, telefon, telefonnummer, rufnummer, mobil, mobilnummer, mobile, cell, cellulare, telefono, teléfono, móvil, handy, fax
PASSPORTNUM: reisepass, reisepassnummer, pass nr, passport, n° de passeport, numéro de passeport, passeport, numero passaporto, numero di passaporto, passaporto, número de pasaporte, pasaporte
IDCARDNUM: personalausweis, personalausweisnummer, ausweis nr, id card, national id card, identity card, carte d'identité, cni, carta d'identità, dni, nie, nif
DRIVERLICENSENUM: führerschein, führerscheinnummer, driving licence, driving license, driver licence, driver license, driver's licence, driver's license, drivers licence, drivers license, driver permit, drivers permit, permis de conduire, [permis*], patente, patente di guida, permiso*, permiso de conducir, driving permit, permit*
TAXNUM: steuer id, idnr, steuernummer, steueridentifikationsnummer, tax id, tax identifier, tax number, tax no, tax identification, tax identification number, tax identity number, tax reference number, taxpayer id, taxpayer identification number, numéro fiscal, numéro d'identification fiscal, número fiscal, numero fiscal, identifiant fiscal, codice fiscale, fiscal*
SOCIALNUM: svnr, sozialversicherungsnummer, ahv, ahv nummer, ahv nr, nir, numéro de sécurité sociale, sécurité sociale, numero di previdenza, previdenza, número de seguridad social, seguridad social, social security, social security number, nss, nuss, ssn, ni number, ni no, national insurance, national insurance number
ACCOUNTNUM: kontonummer, konto, konto nr, bank account, account, account number, numéro de compte, compte, compte bancaire, numero di conto, conto, conto corrente, número de cuenta, cuenta, cuenta bancaria
CREDITCARDNUMBER: credit card, debit card, card number, card no, kreditkarte, kreditkartennummer, kartennummer, carte bancaire, numéro de carte, carta di credito, carta di debito, tarjeta, tarjeta de crédito, tarjeta de débito, tarjeta bancaria
PERSONALREF: kundennummer, kunden nr, customer, n° client, numéro de client, client, codice cliente, n.º de cliente, número de cliente, aktenzeichen, case, [fall], [dossier], [caso], patient, patienten, paziente, paciente, membership, membership number, member number, member no, member*, mitgliedsnummer, numero socio, número de socio, numero di socio, número de socia, numéro de membre, numéro d'adhérent, numero tessera
"""
# Words for a number, after a field name or a business key.
NUMBER_WORDS = "number, nummer, numéro, numero, número, no, nr, n, id, code, ref"
# Keys of business values; what stands directly after one isn't a person's.
BUSINESS_KEYS = "invoice, order, product, sku, rechnung, rechnungsnummer, bestellung, artikel, facture, commande, produit, fattura, ordine, prodotto, factura, pedido, producto, dimension, dimensions, abmessungen, maße, room, zimmer, salle, stanza, habitación, price, preis, prix, prezzo, precio, date, datum, calendar date, quantity, menge"
# Words near an ambiguous name that speak of a person's documents.
PERSONAL_WORDS = "mon, ma, mes, notre, votre, son, sa, ses, titulaire, conducteur, personnel, personnelle, privé, privée, passeport, identité"
# Words that announce a date of birth.
BIRTH_WORDS = "date of birth, birth date, birthdate, birthday, birth, dob, born, born on, geburtsdatum, geboren, geboren am, date de naissance, naissance, né le, née le, data di nascita, nascita, nato il, nata il, fecha de nacimiento, nacimiento, nacido el, nacida el"
# Month names by number.
MONTHS = """
january januar janvier gennaio enero
february februar février febbraio febrero
march märz mars marzo
april avril aprile abril
may mai maggio mayo
june juni juin giugno junio
july juli juillet luglio julio
august août agosto
september septembre settembre septiembre
october oktober octobre ottobre octubre
november novembre noviembre
december dezember décembre dicembre diciembre
"""
# Words that announce an age, link words, units, and things that have an age but aren't persons.
AGE_WORDS = "aged, age, alter, âge, età, edad"
AGE_LINKS = "is, ist, est, è, es, beträgt"
AGE_UNITS = "year, years, jahr, jahre, ans, anni, años"
AGED_THINGS = "product, produkt, produit, prodotto, producto, warranty, garantie, duration, durée, machine, maschine, equipment"
# Words before a telephone extension.
EXTENSIONS = "extension, ext, x, durchwahl, dw, poste, interno, int, anexo, #"
# Upper-case words that are never part of a serial.
NOT_SERIAL = "OK NEXT THEN AND UND ET THE FOR DER DIE DAS VON MIT DEL DES LES NO NR NIF DNI EUR USD CHF GBP"
# Fewest and most national digits by country code, of the eight regions' public numbering plans.
PHONE_PLAN = {"1": (10, 10), "33": (9, 9), "34": (9, 9), "39": (6, 11), "41": (9, 9), "43": (4, 13), "44": (9, 10), "49": (5, 13)}


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]
