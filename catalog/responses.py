"""Seven-part responses derived from a table, as SQL both engines run unchanged.

Every row of the table yields one response.  The variants of each part are picked
by the row's key with coprime divisors, so that over a whole table they meet in
all combinations; the key, status and priority columns go into the texts.
"""

from __future__ import annotations


def _pick(key: str, variants: list[str], spread: int = 1) -> str:
    """CASE over the variants; a variant is a SQL expression."""
    choices = " ".join(f"when {i} then {v}" for i, v in enumerate(variants))
    number = key if spread == 1 else f"({key} * {spread})"
    return f"(case {number} % {len(variants)} {choices} end)"


def _text(*parts: str) -> str:
    """SQL text literal; line breaks become chr(10)."""
    literal = "".join(parts).replace("'", "''")
    return "('" + literal.replace("\n", "' || chr(10) || '") + "')"


def response_expressions(key: str, report: str, mark: str, year: str) -> tuple[str, str]:
    """SQL expressions of the ``report`` and the ``response`` column.

    ``mark`` is a text that goes into the answers, ``year`` a four-digit text.
    """
    t = _text
    q1 = _pick(key, [
        t("Q1. Yes, the automated vehicle was guilty.\n"),
        t("**Q1.** Yes, the car was.\n"),
        t("Q1: No. The other driver was.\n"),
        t("**Q1** Yes.\n"),
        t("Q1. It is unclear from the form.\n"),
        t("Q1: yes, it was.\n"),
        "''",
        t("**Q1. Describe the accident:** No, it was rear-ended.\n"),
        t("Q1. Guilty: No. Others say Yes.\n"),
    ])
    head2 = _pick(key, [t("Q2. "), t("**Q2.** "), t("Q2: "), t("**Q2. Involved parties:** ")])
    av = _pick(key, [
        f"('Automated Vehicle: Year ' || {year} || ', Brand Tesla, Model X')",
        f"('**Vehicle 1 (Autonomous Vehicle):** ' || {year} || ' Chrysler Pacifica')",
        t("Vehicle 1: Tesla model 3"),
        t("Vehicle 1: Tesla Model X"),
        f"('Waymo, Year ' || {year})",
        t("Google AV, Year 2016"),
        f"('Autonomous Vehicle: Year: ' || {year} || ', Brand: Lexus, Model: RX')",
        t("2016 Nissan (make unknown)"),
        t("Involved: a car of status ") + f" || {mark}",
        t("Automated Vehicle: Unknown, Brand Mercedes-Benz, Model not specified"),
        f"('The automated vehicle was a ' || {year} || ' Chevrolet Bolt (' || {mark} || ')')",
        t("Automated Vehicle: Year Unknown, Brand Unknown (likely a Tesla), Model 3"),
        t("Automated Vehicle: Year 2019, Brand  ."),
        t("**Automated Vehicle:** Year: 2021, Brand: Apple Inc., Model: AV"),
        t("One vehicle was involved: a 2017 Volvo XC 90 (autonomous vehicle)"),
        t("2019 Tesla Model X (Autonomous Vehicle)"),
        t("2016 Model C-4 Grand Touring 4D UTV"),
        f"('Vehicle 1: ' || {year} || ' Land Rover Discovery, black')",
        f"('Automated Vehicle: Year ' || {year} || ', Brand Ford, Model F-150')",
        t("Automated Vehicle: Zero-Emission Vehicle"),
        f"('Vehicle 1: ' || {mark} || ' Daimler van')",
        f"('Automated Vehicle: Year ' || {year} || ', Brand Land Rover.')",
        t("Cruise LLC was the operator"),
    ])
    user = _pick(key, [
        t("\nOther Road User: Cyclist"),
        t("\nOther Road User: a female cyclist"),
        t("\n**Other Involved Road User:** driver of a van"),
        "''",
        t("\nOther Road User: \nfoo ") + f" || {mark}",
        t("\nOther Road User: "),
        t("\nOther Road User:Cyclist"),
        t("\nThe other involved party was a pedestrian crossing"),
        t("\na pedestrian was also involved"),
        t("\nOther Involved Party: person on a moped"),
        t("\nThe other involved road user was the MOTORBIKE rider"),
        t("\nOther Road User: stationary object"),
        t("\nOther Road User: 2013 Honda Civic"),
        f"(chr(10) || 'Other Road User:  ' || {mark} || ' ')",
    ], 3)
    vehicle = _pick(key, [
        f"(chr(10) || 'Vehicle 2: ' || {year} || ' Toyota Camry, silver')",
        t("\nOther Vehicle: Year: 2017, Make: Ford, Model: F150"),
        t("\nOther Vehicle: Year Unknown, Brand Ford, Model F-150"),
        t("\nOther Vehicle: Ford pickup truck"),
        t("\nOther Vehicle: A pickup truck"),
        t("\nOther Vehicle: truck"),
        t("\nOther Vehicle: A bicycle"),
        t("\nNo other vehicle was involved"),
        "''",
        t("\n**Other Vehicle:** Year: UNK, Brand: Honda, Model: Civic EX"),
        t("\nHyundai: Sonata (grey)"),
        t("\nOther Car: A Toyota was stopped"),
        t('\nUnknown year, brand and model (only "Truck" is listed)'),
        t('\nA truck is listed as "other vehicle"'),
        f"(chr(10) || 'Vehicle 2: ' || {mark} || ' The autonomous vehicle was hit')",
        t("\nOther Vehicle: Not specified."),
        t("\nOther Vehicle: A 2023: Kia Soul"),
    ], 5)
    q3 = _pick(key, [
        f"(chr(10) || '**Q3.** ' || {mark} || ' Street, two lanes.')",
        t("\nQ3: Main Street."),
        "''",
        t("\nQ3. "),
    ], 3)
    q4 = _pick(key, [
        t("\nQ4. **Weather:** Clear. **Lighting Conditions:** Daylight"),
        t("\n**Q4.** **Weather:** .\n**Road Surface:** Dry\n**Road Conditions:** No unusual conditions"),
        f"(chr(10) || 'Q4: **Weather:** ' || {mark} || '*** **Road Surface:**   Wet  ')",
        t("\nQ4. It was dark."),
        "''",
        t("\n**Q4.** When: 2020.\n**Lighting Conditions:** \n Dusk - dawn\n**Weather:**\n\nRaining."),
        f"(chr(10) || 'Q4. **Road Conditions:** Holes, ' || {mark} || ', gravel. **Weather:** Fog*')",
    ], 5)
    q5 = _pick(key, [
        t("\nQ5. **Vehicle Damage:** The AV sustained minor damage to the bumper."),
        t("\nQ5. **Type of Collision:** Rear end. **Vehicle Damage:** AV damage was minor."),
        t("\n**Q5.** **Vehicle Damage:** AV damage was minor and damage to the door was severe."),
        t("\nQ5: **Vehicle Damage:** Heavy damage elsewhere."),
        t("\nQ5. **Vehicle Damage:** The Toyota had damage to a door.\n"
          "**Injuries/Deaths/Property Damage:** No injuries."),
        t("\nQ5. **Vehicle Damage:** The Honda had damage to a door. The Tesla had Damage, a dent."),
        t("\nQ5. **Injuries/Deaths/Property Damage:** One driver was injured."),
        t("\nQ5. **Injuries/Deaths/Property Damage:** No injury."),
        "''",
        f"(chr(10) || '**Q5.** **Type of Collision:** ' || {mark} || "
        "'. **Vehicle Damage:** Automated vehicle: total damage, destroyed; the other vehicle had"
        " DAMAGE that was extensive* **Injuries/Deaths/Property Damage:** Injuries reported')",
        t("\nQ5. Nothing is known."),
    ], 3)
    q6 = _pick(key, [
        t("\nQ6. The AV was not at fault."),
        t("\nQ6. The driver was at fault. Contributing Factors: speed, weather and glare"),
        t('\nQ6. Contributing Factors: "a,, b" were named'),
        t("\n**Q6.** **Contributing Factors:** speed"),
        t("\nQ6. The autonomous car was hit.\nThe pedestrian was At Fault. Contributing Factors: ;and ,"),
        "''",
        f"(chr(10) || 'Q6: Have a look, ' || {mark} || ' is at fault; Contributing Factors: rain; '"
        f" || {mark} || ' and sandy road* end')",
        t("\nQ6. Nobody was at faults. Contributing Factors: none"),
        t('\nQ6. Contributing Factors: late "braking, distance"\nand "other"'),
    ], 7)
    q7 = _pick(key, [
        t("\nQ7. **Traffic:** Light. The AV was stopped at the light."),
        t("\nQ7: The driver was crossing slowly. different lanes, same direction"),
        t("\n**Q7.** **Traffic:** Heavy\nThe automated vehicle\nwas moving"),
        "''",
        f"(chr(10) || 'Q7. Pedestrian ' || {mark} || ' was WALKING north. The AV and the other road user"
        " were Traveling in the Same Lane. Different direction' || chr(10) || 'Q8: extra')",
        t("\nQ7. Nothing moved."),
        t("\nQ7. **Traffic:** \nModerate * the van was driving away\nQ8. more"),
    ], 11)
    text = " || ".join([q1, head2, av, user, vehicle, q3, q4, q5, q6, q7])
    return (
        f"{report} as report",
        f"case when {key} % 101 = 100 then null else {text} end as response",
    )


ORDERS = response_expressions(
    key="o_orderkey",
    report="'report-' || cast(o_orderkey as string)",
    mark="(o_orderstatus || ' ' || o_orderpriority)",
    year="cast(2010 + o_custkey % 15 as string)",
)

LINEITEM = response_expressions(
    key="(l_orderkey * 8 + l_linenumber + l_partkey)",
    report="'report-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string)",
    mark="(l_returnflag || l_linestatus)",
    year="cast(2010 + l_suppkey % 15 as string)",
)
