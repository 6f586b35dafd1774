import random

import pytest

from inkroll.llm import sentences as S

AM = ["ሰላም ለዓለም።", "እንዴት ነህ።", "ደህና ነኝ።"]
HY = ["Բարև աշխարհ։", "Ինչպես ես։", "Լավ եմ։"]
MY = ["မင်္ဂလာပါ။", "နေကောင်းလား။", "ကောင်းပါတယ်။"]
KM = ["សួស្តី។", "អ្នកសុខសប្បាយទេ។", "ខ្ញុំសុខសប្បាយ។"]
WIDE = ["これは本．", "次の値は３．１４です．", "終わり｡"]
LO = ["ຜູ້ດູແລລຶບໄຟລ໌ຂໍ້ມູນ", "ໂປຣແກຣມຢຸດເຮັດວຽກ", "ສະຄຣິບເກົ່ານັບຄ່າວ່າງ"]
KM_BARE = ["អ្នកគ្រប់គ្រងលុបឯកសារ", "កម្មវិធីឈប់ដំណើរការ", "តារាងចាស់រាប់តម្លៃទទេ"]


@pytest.mark.parametrize("pool, glue", [(AM, " "), (HY, " "), (MY, " "), (KM, " "), (WIDE, ""), (LO, " "), (KM_BARE, " ")])
def test_other_scripts(pool, glue):
    rng = random.Random(4)
    model = S.fit(["\n\n".join(glue.join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(3)) for _ in range(80)])
    for want in (pool, pool[::-1]):
        text = glue.join(want)
        assert [text[a:b] for a, b in S.segment(text, model)] == want
